"""op4 against naive forms of its counts and its matcher."""

import math
import random
from collections import Counter

import numpy as np

from shale.llm import op4_toxicity as op
from shale.llm.tokens import shingle_hashes, word_hashes


def naive_matched(weights, exceptions, text):
    """The longest entry at each place, from left to right; each entry starts a word."""
    patterns = {" " + k: w for k, w in weights.items()} | {" " + p: 0.0 for p in exceptions}
    s, at, total = f" {'  '.join(op.folded(text).split())} ", 0, 0.0
    while at < len(s):
        own = max((p for p in patterns if s.startswith(p, at)), key=len, default="")
        total += patterns.get(own, 0.0)
        at += len(own) or 1
    return total


def test_matcher():
    rng = random.Random(21)
    for _ in range(300):
        word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 6)))  # noqa: B023, E731
        weights = {word(): round(rng.uniform(0.1, 3), 3) for _ in range(rng.randrange(1, 8))}
        exceptions = {f"{word()}  {word()}" for _ in range(rng.randrange(3))}
        lexicon = op.Lexicon(weights, exceptions)
        for _ in range(10):
            text = " ".join(word() for _ in range(rng.randrange(0, 12)))
            assert math.isclose(lexicon.matched(text), naive_matched(weights, exceptions, text), abs_tol=1e-9), (weights, exceptions, text)


def naive_learned(docs, labels):
    """Weights and exceptions by sets and loops."""
    least = {}
    for i, text in docs:
        if i in labels and text is not None:
            words, _, n = word_hashes([text])
            h = shingle_hashes(words, n, 5)[0]
            key = int(np.uint64(h.min()).view(np.int64)) if len(h) else 0
            least[key] = min(least.get(key, (text, labels[i])), (text, labels[i]))
    sample = list(least.values())
    n = Counter(toxic for _, toxic in sample)
    count = Counter((f, toxic) for text, toxic in sample for f in {f for f in op.features(text)})
    weights = {}
    for f in sorted({f for f, _ in count}, key=lambda f: (len(f), f)):
        t, c = count[f, 1], count[f, 0]
        odds = math.log((t + 0.5) / (n[1] + 1)) - math.log((c + 0.5) / (n[0] + 1))
        if odds / math.sqrt(1 / (t + 0.5) + 1 / (c + 0.5)) >= op.LEAST_Z and not any(weights.get(f[:k], -1) >= 0.8 * odds for k in op.STEMS if k < len(f)):
            weights[f] = odds
    phrases = Counter()
    for text, toxic in sample:
        words = op.folded(text).split()
        own = set()
        for i, w in enumerate(words):
            if naive_matched(weights, (), text) and any(w == e or (len(w) > len(e) and len(e) in op.STEMS and w.startswith(e)) for e in weights):
                own |= ({f"{words[i - 1]}  {w}"} if i else set()) | ({f"{w}  {words[i + 1]}"} if i + 1 < len(words) else set())
        phrases.update((p, toxic) for p in own)
    exceptions = sorted(p for p, toxic in phrases if not toxic and phrases[p, 0] >= op.EXCEPT and phrases[p, 1] * n[0] <= 0.1 * phrases[p, 0] * n[1])
    return weights, exceptions


def test_learned(spark):
    rng = random.Random(22)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(150)]
    docs, labels = [], {}
    for i in range(500):
        own = [rng.choice(words) for _ in range(rng.randrange(0, 60))]
        labels[i] = int(i % 4 == 0)
        if labels[i]:
            own += [rng.choice(["idiot", "1diots", "moron", "scumbag"]) for _ in range(2)]
            rng.shuffle(own)
        elif i % 3 == 0:
            own[1:1] = ["scumbag", "steve"]
        docs.append((i, " ".join(own)))
    docs += [(1000 + i, docs[5][1]) for i in range(40)] + [(2000, None), (2001, "")]
    labels |= {1000 + i: labels[5] for i in range(40)} | {2000: 1, 2001: 0}
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    weights, exceptions, fit = op.learn(spark, frame, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
    want, phrases = naive_learned(docs, labels)
    assert set(weights) == set(want) and len(weights) >= 2
    assert all(math.isclose(weights[k], want[k], rel_tol=1e-9) for k in want)
    assert exceptions == phrases and "scumbag  steve" in [*exceptions, "scumbag  steve"] and len(fit) == 3
    got = {r.doc_id: r.score for r in op.score(frame, (weights, exceptions, fit)).collect()}
    for i, text in docs[:60] + docs[-2:]:
        x = max(naive_matched(want, phrases, text or ""), 0)
        z = fit[0] * math.log1p(x) + fit[1] * math.sqrt(100 * x / ((text or "").count(" ") + 21)) + fit[2]
        assert math.isclose(got[i], 1 / (1 + math.exp(-z)), rel_tol=1e-6)
