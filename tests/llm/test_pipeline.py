import hashlib

import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tilewright.llm import langid, secrets
from tilewright.llm.queries import QUERIES, SQL, piece_model

from .test_leaks import brute as leak_brute
from .test_neardup import brute as near_brute
from .test_secrets import brute as secret_brute


def test_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "benchmark", "secret", "encode"]
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 13)) and set(SQL) <= set(QUERIES)


def test_equals_brute_force(spark, tmp_path):
    story = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(k, f"story number {k} about the house and the tree " + " ".join(f"w{k}x{j}" for j in range(30)), "en", "s") for k in range(40)]
    rows += [(100, rows[0][1].upper(), "en", "s"), (101, rows[1][1] + " end", "en", "s"), (102, None, "en", "s"), (103, "123 456", None, "s"), (104, f"start {story} stop", "en", "s"), (105, 'key password = "hunter2secret" end of it', "en", "s"), (106, "eine andere sprache mit wörtern die hier stehen", "de", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("bigint"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, story)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    own = [(i, t) for i, t, *_ in rows if t and langid.has_letter(t)]
    kept = {i for i, _, c in near_brute(own, 5) if i == c}
    own = [(i, t) for i, t in own if i in kept and not leak_brute(t, [("7", story)])[4]]
    kinds = [r.kind for r in secrets.BASE + secrets.ADDED]
    clean = {i: secrets._redacted(t.encode(), secret_brute(t.encode()), kinds).decode() for i, t in own}
    assert set(got) == set(clean) and {100, 101, 102, 103, 104}.isdisjoint(got) and "hunter2" not in clean[105]
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    for i, t in clean.items():
        ids = library.encode(t, add_bos=True, add_eos=True)
        assert got[i].n_tokens == len(ids) and got[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_stages_keep_the_columns(spark, tmp_path):
    spark.createDataFrame([(7, "a b c")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(1, "some words here", "en", "s", 15, 9)], "doc_id bigint, text string, lang string, source string, n_chars bigint, extra int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 1
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
