import base64
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakweave.sinks import files as sinks
from peakweave.sources import spectra_files as sources
from peakweave.sources import tables_text
from peakweave.streaming import search

PEAKS = "array<struct<mz:double,intensity:double,tol:double>>"


@pytest.fixture
def spectra(spark):
    rows = [(k, 500.5 + k, 999.0 + 2 * k, 2, 10.0, [(100.0 + j, 1.5 * j + 1, 0.0) for j in range(3)], {"title": f"t{k}"}) for k in (1, 2, 3)]
    return spark.createDataFrame(rows, f"scan int, parent_mz double, parent_mass double, charge int, precursor_intensity double, peaks {PEAKS}, meta map<string,string>")


@pytest.mark.parametrize("kind", ["mgf", "ms2", "pkl", "pklbin"])
def test_round_trip(spark, spectra, tmp_path, kind):
    out = str(tmp_path / f"x.{kind}")
    sinks.write_spectra(spectra, out, kind)
    got = sources.read_spectra(spark, out, kind).orderBy("parent_mz").collect()
    assert [round(r["parent_mz"], 2) for r in got] == ([501.5, 502.5, 503.5] if kind != "ms2" else [round((m + 1.00727646688) / 2, 2) for m in (1001.0, 1003.0, 1005.0)])
    assert [[(p["mz"], p["intensity"]) for p in r["peaks"]] for r in got] == [[(100.0, 1.0), (101.0, 2.5), (102.0, 4.0)]] * 3
    if kind != "pkl":
        assert sources.by_scan(sources.read_spectra(spark, out, kind), 2).count() == 1
    if kind == "mgf":
        assert got[0]["meta"]["title"] == "t1"


def test_xml(spark, tmp_path):
    pairs = np.array([100.0, 1.0, 200.0, 2.0], ">f4").tobytes()
    (tmp_path / "a.mzXML").write_text(f'<mzXML><msRun><scan num="7" msLevel="1" retentionTime="PT12.5S"><peaks precision="32">{base64.b64encode(pairs).decode()}</peaks><scan num="8" msLevel="2"><precursorMz precursorCharge="2" precursorIntensity="9">450.5</precursorMz><peaks precision="32" compressionType="zlib">{base64.b64encode(zlib.compress(pairs)).decode()}</peaks></scan></scan></msRun></mzXML>')
    got = {r["scan"]: r for r in sources.read_mzxml(spark, str(tmp_path / "a.mzXML")).collect()}
    assert got[7]["ms_level"] == 1 and got[7]["retention_time"] == 12.5 and got[8]["charge"] == 2 and got[8]["parent_mz"] == 450.5
    assert all([(p["mz"], p["intensity"]) for p in r["peaks"]] == [(100.0, 1.0), (200.0, 2.0)] for r in got.values())
    data = lambda xs: base64.b64encode(np.array(xs, "<f8").tobytes()).decode()
    cv = lambda *a: "".join(f'<cvParam accession="{x}" value="{v}"/>' for x, v in a)
    (tmp_path / "a.mzML").write_text(f'<mzML><spectrum id="scan=3">{cv(("MS:1000511", 2), ("MS:1000744", 300.25), ("MS:1000041", 3), ("MS:1000422", ""))}<binaryDataArray>{cv(("MS:1000514", ""), ("MS:1000523", ""))}<binary>{data([1, 2])}</binary></binaryDataArray><binaryDataArray>{cv(("MS:1000523", ""))}<binary>{data([5, 6])}</binary></binaryDataArray></spectrum></mzML>')
    r = sources.read_mzml(spark, str(tmp_path / "a.mzML")).first()
    assert (r["scan"], r["charge"], r["parent_mz"], r["frag_type"], r["peaks"][1]["intensity"]) == (3, 3, 300.25, "HCD", 6.0)


def test_pairs_and_matrix(spark, tmp_path):
    (tmp_path / "p.bin").write_bytes(sinks.pairs_bytes([(0, 4, 1.5, -2.0, 0.5, 0.25)]))
    assert tuple(sources.read_pairs(spark, str(tmp_path / "p.bin")).first()) == (0, 4, 1.5, -2.0, 0.5, 0.25)
    e = spark.createDataFrame([(0, 4, 1.5, -2.0, 0.5, 0.25, 3)], "spec1 long, spec2 long, shift1 double, shift2 double, score1 double, score2 double, component long")
    sinks.pairs_table(e, str(tmp_path / "p.tsv"))
    assert tuple(sources.read_pairs_text(spark, str(tmp_path / "p.tsv")).first()) == tuple(e.first())
    (tmp_path / "m.bin").write_bytes(struct.pack("<II", 2, 2) + np.arange(4.0).tobytes())
    assert [r["values"] for r in sources.read_matrix(spark, str(tmp_path / "m.bin")).orderBy("row_no").collect()] == [[0.0, 1.0], [2.0, 3.0]]
    (tmp_path / "c.clust").write_text("c0 0 2\n\t0 5 400.5 2\n\t1 6 400.6 2\nc1 1 1\n\t0 9 300.0 1\n")
    assert sources.read_clusters(spark, str(tmp_path / "c.clust")).filter("cluster_idx = 0").count() == 2


def test_tables(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">P1 first one\nPEP\nTIDE\n>P2\nAAK*\n")
    got = tables_text.read_fasta(spark, str(tmp_path / "a.fasta")).orderBy("db_index").collect()
    assert [(r["db_index"], r["id"], r["description"], r["sequence"]) for r in got] == [(0, "P1", "first one", "PEPTIDE"), (1, "P2", "", "AAK*")]
    sinks.fasta(tables_text.read_fasta(spark, str(tmp_path / "a.fasta")), str(tmp_path / "b.fasta"))
    assert tables_text.read_fasta(spark, str(tmp_path / "b.fasta")).count() == 2
    (tmp_path / "r.tsv").write_text("#Scan#\tPeptide\tProtein\tCharge\tMQScore\tp-value\n4\tK.PES+80TIDE.R\tXXXP1\t2\t3.5\t1e-3\n")
    r = tables_text.read_psms(spark, str(tmp_path / "r.tsv"), "signed", zero_based=True).first()
    assert (r["scan"], r["annotation"], r["is_decoy"], r["charge"], r["p_value"]) == (5, "K.PE(S,80)TIDE.R", True, 2, 1e-3)
    sinks.psm_table(tables_text.read_psms(spark, str(tmp_path / "r.tsv")), str(tmp_path / "out.tsv"))
    assert tables_text.read_psms(spark, str(tmp_path / "out.tsv")).first()["score"] == 3.5
    with pytest.raises(ValueError):
        tables_text.read_delimited(spark, str(tmp_path / "r.tsv"), required=["nothing"])
    (tmp_path / "x.aln").write_text("CLUSTAL W\n\na  PE-P\nb  P-EP\n\na  TI\nb  TI\n")
    aln = {(r["name"], r["position"]): r["column"] for r in tables_text.read_clustal(spark, str(tmp_path / "x.aln")).collect()}
    assert aln["a", 2] == 3 and aln["b", 1] == 2 and aln["a", 4] == 5


def test_parameters():
    p = tables_text.Parameters.from_text("DIR=/data\r\nFILE=$DIR/x=y\nno value\nN=2.5\nON=1")
    assert p["FILE"] == "/data/x=y" and p.number("N", 0) == 2.5 and p.flag("ON") and "no value" not in p
    x = tables_text.Parameters.from_xml('<parameters><parameter name="a">1</parameter><parameter name="a">2</parameter><parameter name="tolerance.PM_tolerance">0.5</parameter></parameters>')
    assert x.choices("a") == ["1", "2"] and tables_text.from_workflow(x)["TOLERANCE_PM"] == "0.5"
    assert tables_text.read_masses("2\nA=71.03\nG=57.02")["G"] == 57.02
    assert tables_text.read_svm("gamma 0.5\nrho 1\nSV\n2 1:1 3:4\n")["vectors"] == [[1.0, 0.0, 4.0]]


def test_stream(spark, spectra, tmp_path):
    spectra.select("scan", "parent_mz", "peaks").write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(f"scan int, parent_mz double, peaks {PEAKS}").parquet(str(tmp_path / "in"))
    find = lambda b: b.select(F.col("scan").alias("query"), F.explode(F.array(F.lit(7), F.lit(8))).alias("entry")).withColumn("dot", F.col("entry") / 10)
    q = search.search_into(search.filtered(rows, 1), find, str(tmp_path / "out"), str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    assert {(r["query"], r["entry"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, 8), (2, 8), (3, 8)}


def test_projects(spark, spectra, tmp_path):
    spectra.write.parquet(str(tmp_path / "spectra.parquet"))
    assert list(sources.read_project(spark, str(tmp_path))) == ["spectra"]
    (tmp_path / "files.txt").write_text("a.mgf\n# no\n\nb.mgf\n")
    assert sources.listed(spark, str(tmp_path / "files.txt")) == ["a.mgf", "b.mgf"] == sources.listed(spark, "a.mgf; b.mgf")


@pytest.mark.parametrize("kind", ["pklbin", "mzxml", "mzml", "pkl", "dta"])
def test_files_are_bounded(spark, tmp_path, monkeypatch, kind):
    """A partition's spectra go into as many files as their size asks for, and all come back."""
    monkeypatch.setattr(sinks._binary_files, "__defaults__", (1000,))
    monkeypatch.setattr(sinks, "FILE_SPECTRA", 10)
    rows = [(k, 500.5 + k, 999.0 + 2 * k, 2, float(k), [(100.0 + j, 1.5 * j + 1, 0.0) for j in range(k % 5)]) for k in range(100)]
    s = spark.createDataFrame(rows, f"scan int, parent_mz double, parent_mass double, charge int, precursor_intensity double, peaks {PEAKS}").coalesce(1)
    out = tmp_path / f"x.{kind}"
    sinks.write_spectra(s, str(out), kind)
    assert len(list(out.glob("part-*"))) >= 5
    got = sources.read_spectra(spark, str(out), kind).orderBy("parent_mass").collect()
    assert [[(p["mz"], p["intensity"]) for p in r["peaks"]] for r in got] == [[(m, i) for m, i, _ in r[5]] for r in rows]


def test_rewritten_files_leave_nothing_behind(spark, tmp_path):
    rows = spark.createDataFrame([(k, k + 1, 0.0, 0.0, 0.5, 0.5) for k in range(100)], "spec1 long, spec2 long, shift1 double, shift2 double, score1 double, score2 double").coalesce(1)
    encode = lambda held: sinks.pairs_bytes([tuple(r.values()) for r in held])
    for most in (500, 2000):
        sinks._binary_files(rows, str(tmp_path / "p"), "bin", encode, most)
        assert sorted(r["spec1"] for r in sources.read_pairs(spark, str(tmp_path / "p")).collect()) == list(range(100))


def test_readers_hold_few_spectra():
    taken = []

    def rows():
        for k in range(2000):
            taken.append(k)
            yield sources._row("f", k, [(1.0, 2.0)] * (k % 3))

    sizes = []
    for b in sources._batches(rows()):
        sizes.append(b.num_rows)
        assert len(taken) == sum(sizes)
    assert sizes == [sources.SPECTRA] * 4
    assert list(sources._blocks("a\nb\n\nc\n \n\nd")) == ["a\nb", "c", "d"]
