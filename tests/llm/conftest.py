"""Documents that hold the awkward cases: null and empty texts, ties, repeated rows, one very long text, clashing columns."""

import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "row_id long, name string, kept string, ids string, n_words string, batch string, spans string, word string")


def prose(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "é", "ing", "ly"]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


def make_texts():
    rng = random.Random(5)
    passage, other = prose(rng, 70), prose(rng, 45)
    base = [prose(rng, rng.randrange(12, 200)) for _ in range(16)]
    texts = [(i, t) for i, t in enumerate(base)]
    texts += [(20, base[0]), (21, base[0].replace(" ", "\t\n", 3)), (22, base[1] + " tail"), (23, "x " + base[1]), (24, base[2].upper())]
    texts += [(30 + k, f"{prose(rng, 30)} {passage} {prose(rng, 20)} {other if k % 2 else ''}") for k in range(6)]
    texts += [(40, None), (41, ""), (42, " \n\t "), (43, "one"), (44, "one two"), (45, "one two"), (46, None)]
    texts += [(50, prose(rng, 9000)), (51, "the " * 400), (52, "ab" * 3000), (53, passage + " " + passage), (54, "a\n" * 60)]
    texts += [(60, "<|endoftext|> a<|endoftext|>b </s><s> ▁▁a  b▁ \x00\x1c z 日本語 🙂 " + base[3]), (61, "it's  we'll x　y  \r\n z ")]
    texts += [(20, base[0]), (3, prose(rng, 60)), (None, base[4]), (None, prose(rng, 40)), (70, base[5] + "\u0085" + base[5])]
    return texts


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts, tmp_path_factory):
    langs = ["en", "de", None]
    rows = [(i, t, langs[k % 3], f"s{k % 4}" if k % 5 else None, len(t or ""), 7, "a", "b", "c", "d", "e", "f", "g") for k, (i, t) in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("docs") / "docs.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def stored(docs):
    """The rows as the operators see them."""
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def nothing(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "docs.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)
