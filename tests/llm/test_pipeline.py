import corpus_pipeline
from wordloom.llm.secrets import scan_secrets
from pyspark.sql import functions as F

from .fixtures import documents, empty
from .test_join_and_contain import brute_components, brute_contained, with_items
from .test_scans import SECRETS


def test_stages_keep_their_promises(spark, tmp_path):
    _, items = with_items(spark)
    item = next(r.text for r in items.collect() if r.item_id == 4)
    docs = documents(spark, [*SECRETS[:7], (950, "fable faced " * 20 + item + " cab", "aa")])
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_duplicates", "decontamination", "secrets", "mixing"]
    d = str(tmp_path)

    one = stages["language_id"](spark, docs, d)
    ids = lambda df: sorted(repr((r.doc_id, r.text)) for r in df.collect())
    assert one.columns == docs.columns
    gone = {400, 401, 402, 406}
    left = [r.doc_id for r in one.collect()]
    assert not gone & set(left) and len(left) >= docs.count() - len(gone) - 1

    two = stages["near_duplicates"](spark, docs, d)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    stay = {r[0] for r in brute_components(rows, 5, 80) if r[0] == r[2]}
    assert {r.doc_id for r in two.collect()} - {None} == stay - {None} and two.columns == docs.columns

    three = stages["decontamination"](spark, docs, d)
    hit = {r[0] for r in brute_contained(rows, [tuple(r) for r in items.collect()])}
    assert 950 in hit and {r.doc_id for r in three.collect()} == {r[0] for r in rows} - hit

    four = stages["secrets"](spark, docs, d)
    assert four.columns == docs.columns and four.count() == docs.count()
    again = scan_secrets(four.select("text")).where(F.size("_spans") > 0)
    assert again.count() == 0 and ids(four.where("doc_id < 100")) == ids(docs.where("doc_id < 100"))

    five = stages["mixing"](spark, four, d)
    assert five.count() == four.count()


def test_run_and_empty_run(spark, tmp_path):
    _, items = with_items(spark)
    for name, docs in (("some", documents(spark)), ("none", empty(spark))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        items.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert {"doc_id", "taken"} <= set(out.columns)
        assert (out.count() > 30) == (name == "some")


def test_near_duplicates_go_by_row(spark):
    one, two, three, four, five, six = (f"{w} " * 3 + " ".join(f"{w}{i}" for i in range(20)) for w in ("ash", "bay", "cod", "dew", "elm", "fig"))
    rows = [
        (1, one, "s"), (None, one, "s"),  # a copy without id
        (None, two, "s"),  # unique, without id
        (None, three, "s"), (None, three, "t"), (None, three + " end", "u"),  # a group without ids
        (2, four, "s"), (7, four, "s"), (7, five, "s"),  # an id of two texts, one of them a copy
        (8, six, "s"), (8, six, "s"),  # a row given twice
        (None, "", "s"), (None, None, "s"), (9, "", "s"), (9, "", "s"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    found = [(r.doc_id, r.text) for r in out.collect()]
    of_three = [r for r in found if (r[1] or "").startswith("cod")]
    assert len(of_three) == 1 and of_three[0][0] is None
    rest = [(1, one), (None, two), (2, four), (7, five), (8, six), (None, ""), (None, None), (9, "")]
    assert sorted(map(repr, found)) == sorted(map(repr, rest + of_three))
