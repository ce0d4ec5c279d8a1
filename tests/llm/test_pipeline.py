"""The corpus pipeline against the same decisions taken one by one in plain Python."""

import hashlib
import random

import pytest

from lorespark.llm import bpe, decontamination, minhash, secrets, toxicity

corpus_pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(20)
    word = lambda: rng.choice("stone river light cloud night letter morning garden winter road".split()) + str(rng.randrange(400))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(25)) for i in range(6)]
    rows, labels = [], []
    for i in range(300):
        t = prose(rng.randint(20, 120))
        toxic = i % 7 == 0
        if toxic:
            t = f"{t} vileword {prose(10)} awfulword"
        elif i % 11 == 0:
            t = f"{prose(20)} {rng.choice(items)[1]} {prose(20)}"
        elif i % 13 == 0:
            t += ' password = "xK9mQ2vLp0aa" token: deadbeef0123'
        elif i % 5 == 0 and rows:
            t = rows[rng.randrange(len(rows))][1]
            t = (t or "") + rng.choice(["", " tail"])
        rows.append((i, t, "en", "s", len(t), "x"))
        if i % 2 == 0:
            labels.append((i, int(rng.random() > 0.1), int("vileword" in t)))
    rows += [(400, None, None, None, None, None), (401, "", "en", "s", 0, "x"), rows[1], (None, prose(30), "en", "s", 1, "x")]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_against_single_decisions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    at = [link["category"] for link in model["links"]].index("toxic")
    left = [(r.doc_id, r.text) for r in docs.collect() if toxicity.score(model, r.text)[at] < model["links"][at]["cut"]]
    assert not any("vileword" in (t or "") for _, t in left) and len(left) > 240
    known = list({(i, t) for i, t in left if i is not None})
    kept = {i for i, _, _, keep in minhash.brute_force(known, 80) if keep}
    left = [(i, t) for i, t in known if i in kept] + [(i, t) for i, t in left if i is None]
    matcher = decontamination.Matcher([(r.item_id, decontamination.normal(r.text)) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()], 0.08)
    left = [(i, t) for i, t in left if not matcher.find(t)]
    enc = bpe.Encoder(bpe.default_path())
    want = []
    for i, t in left:
        ids, said = enc.encode(secrets.redact(t, secrets.find_secrets(t)))
        want.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert 100 < len(want) < 260


def test_stages_keep_columns_and_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secrets", "bpe"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.dtypes == docs.dtypes, name
        if name == "secrets":
            changed = [r for r in out.collect() if "[SECRET]" in (r.text or "")]
            assert changed and all("deadbeef0123" not in r.text and r.n_chars == len(r.text) for r in changed)
            assert out.count() == docs.count()
        else:
            assert 0 < out.count() < docs.count(), name


def test_empty_tables(spark, folder, tmp_path):
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_all_documents_dropped_midway(spark, tmp_path):
    """Very long, null and empty texts pass the first stages; then every document holds an item."""
    item = "the quick brown stone walks over the silent river at dawn"
    rows = [(i, f"{item} {i} " + "filler word " * (60_000 if i == 0 else 2 * i), "en", "s", 1, "x") for i in range(6)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (1, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.near_dedup_stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).count() > 1
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
