import hashlib

import corpus_pipeline
import public_tokenizers
from helpers import documents, rows, sentence
from test_decontam import by_force
from test_dedup import lines_by_force, near_by_force
from tokenizers import Tokenizer

from logloom.llm.langid import identify


def test_stages_against_brute_force(spark, tmp_path):
    folder = f"file://{tmp_path}"
    shared = sentence(2, 60).split()
    items = [(1, " ".join(shared[10:30])), (2, None)]
    documents(spark).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    columns = documents(spark).columns

    def after(name, docs):
        out = stages[name](spark, docs, folder)
        out.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    def pairs(df):
        return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    judged = {r["doc_id"]: r for r in identify(docs).collect() if r["doc_id"] is not None}
    first = after("language_id", docs)
    want = [(r[0], r[1]) for r in rows() if r[1] and any(c.isalpha() for c in r[1]) and (r[0] is None or judged[r[0]]["score"] >= 0.5)]
    assert pairs(first) == sorted(want, key=repr) and first.columns == columns

    second = after("line_dedup", first)
    assert pairs(second) == sorted(((d, kept) for d, _, _, kept in lines_by_force(want)), key=repr) and second.columns == columns

    third = after("near_dedup", second)
    components = near_by_force(pairs(second), 5, 80)
    want = [(d, t) for d, t in pairs(second) if d is None or components[d][1] == d]
    assert pairs(third) == sorted(want, key=repr) and third.columns == columns and len(want) < len(pairs(second))

    fourth = after("decontamination", third)
    hit = {d for d, _, n, _ in by_force(pairs(third), items, 10) if n}
    assert hit and pairs(fourth) == [x for x in pairs(third) if x[0] not in hit] and fourth.columns == columns

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for d, t in pairs(fourth):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    for out in (stages["bpe"](spark, fourth, folder), corpus_pipeline.run(spark, folder)):
        assert sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out.collect()), key=repr) == sorted(want, key=repr)


def test_empty_pipeline(spark, tmp_path):
    folder = f"file://{tmp_path}"
    documents(spark, []).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
