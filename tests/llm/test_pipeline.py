import hashlib
import random

import public_tokenizers
import sentencepiece

import corpus_pipeline as pipeline
from shale.llm import op2_sentencepiece, op5_decontaminate, op10_quality_rules

LIB = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(op2_sentencepiece.MODEL))


def documents(rng):
    vocab = ["the", "of", "and"] * 100 + [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}x" for i in range(1500)]
    pick = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(pick(30))) for i in range(5)]
    rows, fate = [], {}
    for i in range(60):
        rows.append([i, " ".join(pick(200)), "en", f"s{i % 3}", 0])
        fate[i] = "kept"
    for i in range(60, 70):  # near and exact copies
        w = rows[i - 60][1].split()
        if i % 2:
            w[rng.randrange(200)] = "changed"
        rows.append([i, " ".join(w), "en", "copy", 0])
        fate[i] = "copy"
    for i in range(70, 75):
        w = pick(200)
        w[50:50] = items[i - 70][1].upper().split()
        rows.append([i, " ".join(w), "en", "leak", 0])
        fate[i] = "leak"
    for i in range(75, 80):
        w = pick(120)
        w[60:60] = [f"mail{i}@example.com", "+1 555 123 4567"]
        rows.append([i, " ".join(w), "en", "pii", 0])
        fate[i] = "pii"
    rows += [[80, " ".join(["the"] * 300), "en", "junk", 0], [81, "too short", "en", "junk", 0], [82, None, None, None, None], [83, "", "en", "x", 0], [84, " ".join(x + "###" for x in pick(200)), "en", "junk", 0]]
    fate |= dict.fromkeys(range(80, 85), "junk")
    return [(*r, "clash", "clash", 7) for r in rows], items, fate


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _rid string, `_row` string, fp int"


def test_stages(spark, tmp_path):
    rows, items, fate = documents(random.Random(17))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), set(fate)
    gone = {"quality": "junk", "near_duplicates": "copy", "decontaminate": "leak"}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids -= {i for i, f in fate.items() if f == gone.get(name)}
        assert {r.doc_id for r in docs.collect()} == ids, name
    texts = {r.doc_id: r.text for r in docs.collect()}
    originals = {r[0]: r[1] for r in rows}
    for i, text in texts.items():
        want = originals[i].replace(f"mail{i}@example.com", "[EMAIL]").replace("+1 555 123 4567", "[PHONE]")
        assert text == want
    got = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in pipeline.run(spark, str(tmp_path)).collect()}
    for i in ids:
        tokens = LIB.encode(texts[i], add_bos=True, add_eos=True)
        assert got[i] == (len(tokens), hashlib.sha256(LIB.decode(tokens).encode()).hexdigest())
    assert set(got) == ids


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_rules_pass_other_columns(spark):
    text = "the quick fox of and " + " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(1, text, "a"), (1, text, "a"), (2, None, "b"), (None, text, None)], "doc_id long, text string, n_words string")
    assert sorted(map(str, op10_quality_rules.filter_documents(docs).collect())) == sorted(map(str, [r for r in docs.collect() if r.text]))
    assert op5_decontaminate.decontaminate(docs, spark.createDataFrame([(1, "x y")], "item_id long, text string")).count() == 4
