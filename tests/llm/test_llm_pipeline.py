import random

import pytest

import corpus_pipeline
from netloom.llm import bpe, secrets

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with planted cases of every stage."""
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice(("an", "er", "on", "th", "st", "ou", "re", "mi")) for _ in range(rng.randint(2, 4))) for _ in range(n))
    rows, labels = [], []
    for i in range(240):
        text = prose(80)
        if i % 4 == 0:
            text += " gorblat " + prose(3) + " fizmuck"
        rows.append((i, text))
        labels.append((i, 1, int(i % 4 == 0)))
    item = prose(30)
    near = rows[1][1].split()
    near[-1] = "changed"
    rows += [(500, " ".join(near)), (501, rows[1][1]), (502, item + " " + prose(60)), (503, prose(60) + " token = " + "0f" * 20), (504, None), (505, "")]
    root = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], DOC).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), dict(rows)


def test_stages_take_effect(spark, folder):
    root, texts = folder
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, root).collect()}
    assert set(got) == {i for i in range(240) if i % 4} | {503, 504}
    import public_tokenizers as tok

    enc = bpe.encoding(tok.path(bpe.RANKS), tok.PATTERN)
    for i, r in got.items():
        assert r.exact and r.n_tokens == len(r.ids) and r.ids == enc.encode_ordinary(r.text or "")
        assert r.text == texts[i] or i == 503 and r.text.endswith(" [SECRET]") and r.n_chars == len(r.text)
    assert secrets.scan(spark.createDataFrame([(got[503].text,)], "text string")).first().spans == []


def test_stages_keep_columns_and_accept_no_rows(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "tokens"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), folder[0])
        assert out.count() == 0
        assert name == "tokens" or out.columns == docs.columns and out.dtypes == docs.dtypes
    assert corpus_pipeline.ORACLE_SQL is None
