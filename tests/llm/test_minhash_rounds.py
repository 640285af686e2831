"""Rounds of near-duplicate detection carry only what can still be linked."""

from murkwatch.llm import minhash


def test_labels_of_documents_without_a_shared_bucket_take_no_part_in_rounds(spark, monkeypatch, tmp_path):
    lone = [(i, " ".join(f"w{i}x{k}" for k in range(40))) for i in range(10, 60)]
    words = [f"v{k}" for k in range(60)]
    near = [(1, " ".join(words)), (2, " ".join(words + ["tail"])), (3, " ".join(["head"] + words)), (4, None)]
    merged, held = minhash._merged, []

    def counted(labels, links):
        held.append(labels.count())
        return merged(labels, links)

    monkeypatch.setattr(minhash, "_merged", counted)
    docs = spark.createDataFrame(lone + near, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    out = {r.doc_id: r for r in minhash.components(spark.read.parquet(str(tmp_path / "docs")), 3, 80).collect()}
    assert held and max(held) == 3
    assert [out[i].component_id for i in (1, 2, 3, 4)] == [1, 1, 1, 4]
    assert all(out[i].component_id == i and out[i].kept for i, _ in lone)


def test_only_texts_of_wanted_documents_are_exchanged_for_their_sets(spark):
    docs = spark.range(20_000).selectExpr("CASE WHEN id % 5000 = 7 THEN NULL ELSE id - 100 END AS doc_id", "'a b c' AS text")
    wanted = docs.where("doc_id IS NULL OR doc_id % 40 = 3").selectExpr("doc_id AS rep").distinct()
    met = minhash._marked(docs, wanted)
    assert met.where("doc_id IS NULL").count() == 4
    assert met.where("doc_id % 40 = 3").count() == docs.where("doc_id % 40 = 3").count() == met.where("doc_id IS NOT NULL AND doc_id % 40 = 3").distinct().count()
    assert met.count() < 600
