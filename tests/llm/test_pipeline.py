"""The stages against brute force, on the smallest table and on awkward rows."""

import re
import zlib

import numpy as np
import public_tokenizers as public
import pytest
from pyspark.sql import functions as F
from test_texts import BASE, luhn
from tokenizers import Tokenizer

import corpus_pipeline
from peakweave.llm import packing, private_data, quality

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """(name, input rows, output) of each stage, written and read again in between."""
    now, out = spark.read.parquet(f"{D}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = now
        stage(spark, now, D).write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/stage-{k}")
        now = spark.read.parquet(path)
        out.append((name, before, now))
    return out


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns(stages, spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    assert all(out.columns == docs.columns for _, _, out in stages[:-1])
    assert sorted(map(tuple, corpus_pipeline.run(spark, D).select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, stages[-1][2].select("doc_id", "piece", "ids_crc32").collect()))


def test_quality_stage(stages, spark):
    _, before, after = stages[0]
    net = quality.fit(before, spark.read.parquet(f"{D}/labels.parquet").filter(~quality.held_out()))
    rows = by_id(before)
    ids = sorted(rows)
    scores = dict(zip(ids, net.scores([(rows[i]["text"] or "").encode() for i in ids]), strict=True))
    assert set(by_id(after)) == {i for i in ids if scores[i] >= corpus_pipeline.LEAST_QUALITY}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1 and i in rows]
    assert sum(i in by_id(after) for i in good) / len(good) > 0.9


def similar_classes(texts):
    """id -> smallest id of its class, by all pairs of shingle sets."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_near_duplicate_stage(stages):
    _, before, after = stages[1]
    want = similar_classes({i: r["text"] for i, r in by_id(before).items()})
    assert sorted(by_id(after)) == sorted(set(want.values())) and after.count() == len(set(want.values())) < len(want)


def labelled(text):
    """The text with base spans replaced, by the plain patterns."""
    spans = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind != "ip" or all(int(x) <= 255 for x in m[0].split("."))) and (kind != "card" or (12 <= len(digits) <= 19 and luhn(digits))) and (kind != "phone" or 9 <= len(digits) <= 15):
                spans.append((m.start(), list(BASE).index(kind), m.end(), kind))
    out, at = [], 0
    for a, _, b, kind in sorted(spans):
        if a >= at:
            out.append(text[at:a] + f"[{kind.upper()}]")
        at = max(at, b)
    return "".join(out) + text[at:]


def test_private_data_stage(stages):
    _, before, after = stages[2]
    told = {r["doc_id"] for r in private_data.private_data(before).filter("n_term > 0").collect()}
    rows, out = by_id(before), by_id(after)
    assert set(rows) == set(out)
    for i, r in out.items():
        assert r["n_chars"] == len(r["text"] or "") if r["text"] is not None else True
        if i not in told:
            assert r["text"] == (None if rows[i]["text"] is None else labelled(rows[i]["text"]))
    assert any(r["text"] != rows[i]["text"] for i, r in out.items())


def test_packing_stage(stages):
    _, before, after = stages[3]
    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    want = []
    for i, r in by_id(before).items():
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % packing.CAPACITY or min(packing.CAPACITY, len(ids))
        cuts = [0, *range(first, len(ids) + 1, packing.CAPACITY)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted(map(tuple, after.select("doc_id", "piece", "start", "length", "ids_crc32").collect())) == sorted(want)
    sums = after.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert all(r["n"] <= packing.CAPACITY for r in sums) and len(sums) <= -(-sum(r["n"] for r in sums) // packing.CAPACITY) + 2


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_awkward_rows(spark, awkward, nothing, stage, tmp_path):
    """Nulls, empty and long texts, repeated rows, columns with clashing names, and no rows at all; labels may be absent."""
    extra = awkward.withColumns({"n_chars": F.lit(1).cast("long"), "lang": F.lit("en"), "source": F.lit("s")})
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = stage(spark, extra, str(tmp_path))
    ids = [r["doc_id"] for r in out.collect()]
    if stage is corpus_pipeline.near_duplicate_stage:
        assert sorted(i or -1 for i in ids) == [-1, 1, 2, 4, 5, 7, 8]
    elif stage is corpus_pipeline.packing_stage:
        assert sorted(set(i or -1 for i in ids)) == [-1, *range(1, 9)]
    else:
        assert sorted(i or -1 for i in ids) == sorted(r["doc_id"] or -1 for r in awkward.collect()) and out.columns == extra.columns
    assert stage(spark, extra.limit(0), str(tmp_path)).count() == 0
