"""Queries over files: tables written in a format and read again. The SQL says what must come back, so writer and reader are both checked."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from peakweave.operators import peaks as P
from peakweave.operators import spectra as S
from peakweave.plans.psm_queries import _ANN, _annotated
from peakweave.session import scratch, ship, written
from peakweave.sinks import files as sinks
from peakweave.sources import spectra_files as files
from peakweave.sources import tables_text as tables
from peakweave.sources.tables import table, view, with_views


def _spectra(spark, d):
    """All spectra: scan, masses, charge, kind and peaks; the scan is kept as the precursor's intensity too, as some formats hold no number."""
    s = view(spark, d, "spectra").select("spec_idx", "parent_mass", "charge", "frag_type")
    g = P.gathered(view(spark, d, "peaks").select("spec_idx", "mz", "intensity")).join(s, "spec_idx")
    return g.select(F.col("spec_idx").cast("int").alias("scan"), "parent_mass", F.col("parent_mass").alias("parent_mz"), "charge", F.lit("HCD").alias("frag_type"), F.lit(2).alias("ms_level"), (F.col("spec_idx") / 2).alias("retention_time"), F.col("spec_idx").cast("double").alias("precursor_intensity"), "peaks")


def _back(spark, d, kind, keep=("scan", "charge")):
    """The spectra after a round trip through a format, found by the path's extension."""
    ship(spark)
    path = scratch(spark, "files") + f".{kind}"
    sinks.write_spectra(_spectra(spark, d), path, kind)
    return _shown(files.read_spectra(spark, path), keep)


def _shown(read, keep=("scan", "charge")):
    total = lambda f: F.aggregate("peaks", F.lit(0.0), lambda a, p: a + p[f])
    named = [F.col("precursor_intensity").cast("int").alias("scan") if c == "numbered" else F.col(c) for c in keep]
    return read.select(*named, F.round("parent_mz", 4).alias("parent_mz"), F.size("peaks").alias("n_peaks"), F.round(total("mz"), 4).alias("mz_sum"), F.round(total("intensity"), 2).alias("total"))


def file_mgf(spark, d):
    return _back(spark, d, "mgf")


def file_mgf_scan_range(spark, d):
    path = scratch(spark, "files") + ".mgf"
    sinks.mgf(_spectra(spark, d), path)
    return _shown(files.by_scan(files.read_mgf(spark, path), 100, 299))


def file_mgf_one_scan(spark, d):
    path = scratch(spark, "files") + ".mgf"
    sinks.mgf(_spectra(spark, d), path)
    return _shown(files.by_scan(files.read_mgf(spark, path), 7))


def file_pkl(spark, d):
    return _back(spark, d, "pkl", ("numbered", "charge"))


def file_pkl_mic(spark, d):
    path = scratch(spark, "files") + ".mic"
    sinks.pkl(_spectra(spark, d), path)
    return files.read_spectra(spark, path).select("charge", F.round("parent_mass", 4).alias("parent_mass"), F.size("peaks").alias("n_peaks"))


def file_dta(spark, d):
    path = scratch(spark, "files") + ".dta"
    sinks.dta(_spectra(spark, d), path)
    return files.read_spectra(spark, path).select("charge", F.round("parent_mass", 4).alias("parent_mass"), F.size("peaks").alias("n_peaks"))


def file_ms2(spark, d):
    path = scratch(spark, "files") + ".ms2"
    sinks.ms2(_spectra(spark, d), path)
    return files.read_spectra(spark, path).select("scan", "charge", F.round("parent_mass", 4).alias("parent_mass"), F.size("peaks").alias("n_peaks"))


def file_prms(spark, d):
    path = scratch(spark, "files") + ".prms"
    sinks.prms(_spectra(spark, d), path)
    return files.read_spectra(spark, path).select("scan", "charge", F.round("parent_mass", 4).alias("parent_mass"), F.size("peaks").alias("n_peaks"), "frag_type")


def file_mzxml(spark, d):
    return _back(spark, d, "mzxml", ("scan", "charge", "ms_level", "retention_time", "precursor_intensity"))


def file_mzml(spark, d):
    return _back(spark, d, "mzml", ("scan", "charge", "ms_level", "retention_time", "precursor_intensity"))


def file_pklbin(spark, d):
    return _back(spark, d, "pklbin", ("scan", "charge", "frag_type", "ms_level"))


def file_pklbin_with_matches(spark, d):
    from peakweave.operators import psms

    path = scratch(spark, "files") + ".pklbin"
    sinks.binary_spectra(_spectra(spark, d), path)
    m = view(spark, d, "psms").select("psm_id", "scan", "annotation")
    return psms.attach(m, files.read_binary_spectra(spark, path).select("scan", F.size("peaks").alias("n_peaks")), ("scan",))


def file_many(spark, d):
    """Two files of different formats, in one list."""
    s, base = written(_spectra(spark, d), "files"), scratch(spark, "files")
    sinks.mgf(s.filter("charge <= 2"), base + "-a.mgf")
    sinks.mgf(s.filter("charge > 2"), base + "-b.mgf")
    spark.createDataFrame([("# a list of files",), (base + "-a.mgf",), (base + "-b.mgf",)], "value string").coalesce(1).write.text(base + ".lst")
    return _shown(files.read_spectra(spark, ",".join(files.listed(spark, base + ".lst")), "mgf"))


def file_project(spark, d):
    folder = scratch(spark, "project")
    view(spark, d, "psms").write.parquet(f"{folder}/psms.parquet")
    _spectra(spark, d).write.parquet(f"{folder}/spectra.parquet")
    found = files.read_project(spark, folder)
    counts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, t in sorted(found.items())]
    return counts[0].union(counts[1])


def _psms(spark, d):
    p = view(spark, d, "psms")
    return p.select("scan", F.concat(F.lit("f"), F.col("file_idx").cast("string")).alias("spectrum_file"), F.concat(F.lit("K."), F.upper("annotation"), F.lit(".R")).alias("annotation"), "protein", "charge", "score", (1 / (1 + F.col("score"))).alias("p_value"), "is_decoy", F.col("psm_id").cast("string").alias("library_id"))


_MATCH = ("scan", "spectrum_file", "annotation", "protein", "charge", "score", "is_decoy")


def file_psm_table(spark, d):
    path = scratch(spark, "psms")
    sinks.psm_table(_psms(spark, d), path)
    return tables.read_psms(spark, path).select(F.col("library_id").cast("long").alias("psm_id"), *_MATCH, F.round("p_value", 9).alias("p_value"))


def file_psm_tables(spark, d):
    """Several files, scans from 0."""
    a, b = scratch(spark, "psms"), scratch(spark, "psms")
    sinks.psm_table(_psms(spark, d).filter("charge < 2"), a)
    sinks.psm_table(_psms(spark, d).filter("charge >= 2"), b)
    return tables.read_psms(spark, [a, b], zero_based=True).select(F.col("library_id").cast("long").alias("psm_id"), *_MATCH)


def file_psm_signed(spark, d):
    """Modifications written with signs, under other headers."""
    from peakweave.functions import peptide

    path = scratch(spark, "psms")
    a = _annotated(spark, d)
    a.select(F.col("psm_id").alias("Scan Number"), peptide.to_signed(F.col("annotation")).alias("Peptide"), F.when(F.col("is_decoy"), "XXXp").otherwise("p").alias("Protein Accession")).write.csv(path, sep="\t", header=True)
    return tables.read_psms(spark, path, "signed").select(F.col("scan").cast("long").alias("psm_id"), "annotation", "orig_annotation", "is_decoy")


def _edges(spark, d):
    l = table(spark, d, "lineitem")
    return l.select(F.col("l_orderkey").alias("spec1"), F.col("l_partkey").alias("spec2"), F.col("l_quantity").alias("shift1"), (-F.col("l_discount")).alias("shift2"), F.col("l_tax").alias("score1"), F.col("l_discount").alias("score2"), F.col("l_linenumber").cast("long").alias("component"))


def file_pairs_binary(spark, d):
    path = scratch(spark, "pairs")
    sinks.pairs_binary(_edges(spark, d), path)
    return files.read_pairs(spark, path)


def file_pairs_text(spark, d):
    path = scratch(spark, "pairs")
    sinks.pairs_table(_edges(spark, d), path)
    return files.read_pairs_text(spark, path)


def file_matrix(spark, d):
    path = scratch(spark, "matrix")
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_no"), F.transform("embedding", lambda x: x.cast("double")).alias("values"))
    sinks.matrix(rows.repartitionByRange(1, "row_no"), path)
    return files.read_matrix(spark, path).select("row_no", F.size("values").alias("n"), F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def file_clusters(spark, d):
    path = scratch(spark, "clusters")
    o = table(spark, d, "orders")
    members = o.select(F.col("o_custkey").cast("int").alias("cluster_idx"), (F.col("o_orderkey") % 3).cast("int").alias("file_idx"), F.col("o_orderkey").cast("int").alias("scan"), F.col("o_totalprice").alias("parent_mz"), F.substring("o_orderpriority", 1, 1).cast("int").alias("charge"))
    sinks.clusters(members, path)
    return files.read_clusters(spark, path)


def file_fasta(spark, d):
    path = scratch(spark, "proteins") + ".fasta"
    p = table(spark, d, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("description"), F.regexp_replace(F.upper(F.concat("p_type", "p_name")), "[^A-Z]", "").alias("sequence"), "p_partkey")
    sinks.fasta(p.repartitionByRange("p_partkey").sortWithinPartitions("p_partkey"), path)
    out = tables.read_fasta(spark, path)
    return out.select("id", "description", "sequence", F.min("db_index").over(Window.partitionBy(F.lit(0))).alias("first_index"))


def file_clustal(spark, d):
    path = scratch(spark, "alignment")
    n = table(spark, d, "nation")
    row = F.concat("n_name", F.lit("   "), F.rpad(F.concat(F.repeat(F.lit("-"), F.col("n_regionkey")), F.regexp_replace(F.upper("n_name"), "[^A-Z]", "")), 40, "-"))
    n.select(F.regexp_replace(row, "^([A-Za-z_]+) +([A-Za-z_]+)   ", "$1_$2   ").alias("value")).coalesce(1).write.text(path)
    return tables.read_clustal(spark, path)


def file_report(spark, d):
    path = scratch(spark, "report")
    sinks.report(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return tables.read_report(spark, path, ["index", "name", "group"])


def file_delimited(spark, d):
    path = scratch(spark, "delimited")
    table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal").write.csv(path, sep=",")
    return tables.read_delimited(spark, path, ",", ["key", "balance"], "key long, name string, balance double")


def file_csv(spark, d):
    path = scratch(spark, "csv")
    table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal").write.csv(path, header=True)
    return tables.read_delimited(spark, path, ",", ["s_suppkey"])


def file_tags(spark, d):
    path = scratch(spark, "tags")
    t = table(spark, d, "part").select(F.col("p_partkey").alias("spec_idx"), F.substring("p_brand", 1, 3).alias("tag"), F.col("p_size").cast("double").alias("before"), (F.col("p_size") * 2.5).alias("after"), F.col("p_retailprice").alias("score"))
    sinks.tags(t, path)
    return tables.read_tags(spark, path)


def file_graphviz(spark, d):
    path = scratch(spark, "graph")
    sinks.graphviz(_edges(spark, d), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def file_html_report(spark, d):
    path = scratch(spark, "html")
    sinks.html(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), path, "Customers", 100)
    rows = spark.read.text(path).select(F.explode(F.regexp_extract_all("value", F.lit("<tr><td>(.*?)</td></tr>"), F.lit(1))).alias("row"))
    return rows.select(F.split("row", "</td><td>")[0].cast("long").alias("c_custkey"), F.split("row", "</td><td>")[2].alias("c_mktsegment"))


def file_parameters(spark, d):
    """Parameters from nations, as text and as XML, with a reference to another one."""
    names = [(r["n_nationkey"], r["n_name"]) for r in table(spark, d, "nation").select("n_nationkey", "n_name").collect()]  # a list of options
    text = "BASE=x\n" + "".join(f"KEY{k}=$BASE/{n}\n" for k, n in names)
    xml = "<parameters>" + "".join(f'<parameter name="{k % 3}">{n}</parameter>' for k, n in sorted(names)) + "</parameters>"
    p, x = tables.Parameters.from_text(text), tables.Parameters.from_xml(xml)
    return spark.createDataFrame([*p.items(), *x.items()], "name string, value string")


def set_append(spark, d):
    s = view(spark, d, "spectra").select("spec_idx", "frag_type", "charge")
    return S.append(S.of_kind(s, "F"), S.of_kind(s, "O", "P").drop("charge")).withColumn("charge", F.coalesce("charge", F.lit(-1)))


def set_parts(spark, d):
    s = S.parts(view(spark, d, "spectra").select("spec_idx"), 8)
    return s.groupBy().agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("first_part"), F.max("part").alias("last_part"))


def set_parallel(spark, d):
    g = written(P.gathered(view(spark, d, "peaks").select("spec_idx", "mz", "intensity")).join(view(spark, d, "spectra").select("spec_idx", "frag_type"), "spec_idx"), "sets")  # numbering reads each set several times
    m = S.parallel(S.of_kind(g, "F"), S.of_kind(g, "O"), S.of_kind(g, "P"))
    return m.select("position", "n_merged", F.size("peaks").alias("n_peaks"), F.round(F.aggregate("peaks", F.lit(0.0), lambda a, p: a + p["intensity"]), 2).alias("total"))


def set_extracted(spark, d):
    wanted = table(spark, d, "events").select(F.col("event_id").alias("spec_idx"), F.col("event_type").alias("note"))
    return S.extracted(view(spark, d, "spectra").select("spec_idx", "charge"), wanted, ["spec_idx"])


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and not f.__name__.startswith("_")}

_S = "t AS (SELECT spec_idx, count(*)::INT AS n_peaks, round(sum(mz), 4) AS mz_sum, round(sum(intensity), 2) AS total FROM peaks GROUP BY 1)"
_SF = "t AS (SELECT spec_idx, count(*)::INT AS n_peaks, round(sum(mz::FLOAT::DOUBLE), 4) AS mz_sum, round(sum(intensity::FLOAT::DOUBLE), 2) AS total FROM peaks GROUP BY 1)"
_XML = with_views(f"WITH {_S} SELECT spec_idx::INT AS scan, charge, 2::INT AS ms_level, spec_idx / 2 AS retention_time, spec_idx::DOUBLE AS precursor_intensity, parent_mass AS parent_mz, n_peaks, mz_sum, total FROM spectra JOIN t USING (spec_idx)", "spectra", "peaks")


def _text(where: str = "true") -> str:
    return with_views(f"WITH {_S} SELECT spec_idx::INT AS scan, charge, parent_mass AS parent_mz, n_peaks, mz_sum, total FROM spectra JOIN t USING (spec_idx) WHERE {where}", "spectra", "peaks")


_PSM = "scan, concat('f', file_idx::VARCHAR) AS spectrum_file, concat('K.', upper(annotation), '.R') AS annotation, protein, charge, score, is_decoy"
_ALN = "a AS (SELECT replace(n_name, ' ', '_') AS name, rpad(concat(repeat('-', n_regionkey), regexp_replace(upper(n_name), '[^A-Z]', '', 'g')), 40, '-') AS r FROM nation), l AS (SELECT name, r, unnest(range(0, 40)) AS c FROM a)"
ORACLES = {
    "file_mgf": _text(),
    "file_mgf_scan_range": _text("spec_idx BETWEEN 100 AND 299"),
    "file_mgf_one_scan": _text("spec_idx = 7"),
    "file_pkl": _text(),
    "file_many": _text(),
    "file_pkl_mic": with_views(f"WITH {_S} SELECT charge, round(CASE WHEN charge > 0 THEN parent_mass * charge - charge + 1.00727646688 ELSE parent_mass END, 4) AS parent_mass, n_peaks FROM spectra JOIN t USING (spec_idx)", "spectra", "peaks"),
    "file_dta": with_views(f"WITH {_S} SELECT charge, parent_mass, n_peaks FROM spectra JOIN t USING (spec_idx)", "spectra", "peaks"),
    "file_ms2": with_views(f"WITH {_S} SELECT spec_idx::INT AS scan, charge, parent_mass, n_peaks FROM spectra JOIN t USING (spec_idx)", "spectra", "peaks"),
    "file_prms": with_views(f"WITH {_S} SELECT spec_idx::INT AS scan, charge, parent_mass, n_peaks, 'PRM' AS frag_type FROM spectra JOIN t USING (spec_idx)", "spectra", "peaks"),
    "file_mzxml": _XML,
    "file_mzml": _XML,
    "file_pklbin": with_views(f"WITH {_SF} SELECT spec_idx::INT AS scan, charge, 'HCD' AS frag_type, 2::INT AS ms_level, parent_mass AS parent_mz, n_peaks, mz_sum, total FROM spectra JOIN t USING (spec_idx)", "spectra", "peaks"),
    "file_pklbin_with_matches": with_views(f"WITH {_S} SELECT psm_id, scan, annotation, n_peaks FROM psms JOIN t ON scan = spec_idx", "psms", "peaks"),
    "file_project": "SELECT 'psms' AS name, count(*) AS n FROM events UNION ALL SELECT 'spectra', count(DISTINCT l_orderkey) FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "file_psm_table": with_views(f"SELECT psm_id, {_PSM}, round(1 / (1 + score), 9) AS p_value FROM psms", "psms"),
    "file_psm_tables": with_views(f"SELECT psm_id, (scan + 1)::INT AS scan, {_PSM.removeprefix('scan, ')} FROM psms", "psms"),
    "file_psm_signed": f"WITH {_ANN} SELECT psm_id, annotation, concat(substr(plain, 1, 1), '+', (size * 1.5)::DECIMAL(9,1)::VARCHAR, substr(plain, 2)) AS orig_annotation, is_decoy FROM ann",
    "file_pairs_binary": "SELECT (l_orderkey + 1)::FLOAT::BIGINT - 1 AS spec1, (l_partkey + 1)::FLOAT::BIGINT - 1 AS spec2, l_quantity::FLOAT::DOUBLE AS shift1, (-l_discount)::FLOAT::DOUBLE AS shift2, l_tax::FLOAT::DOUBLE AS score1, l_discount::FLOAT::DOUBLE AS score2 FROM lineitem",
    "file_pairs_text": "SELECT l_orderkey AS spec1, l_partkey AS spec2, l_quantity AS shift1, -l_discount AS shift2, l_tax AS score1, l_discount AS score2, l_linenumber::BIGINT AS component FROM lineitem",
    "file_matrix": "SELECT (row_number() OVER (ORDER BY vec_id) - 1)::BIGINT AS row_no, len(embedding)::INT AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings",
    "file_clusters": "SELECT o_custkey::INT AS cluster_idx, (o_orderkey % 3)::INT AS file_idx, o_orderkey::INT AS scan, o_totalprice AS parent_mz, substr(o_orderpriority, 1, 1)::INT AS charge FROM orders",
    "file_fasta": "SELECT concat('P', p_partkey::VARCHAR) AS id, p_brand AS description, regexp_replace(upper(concat(p_type, p_name)), '[^A-Z]', '', 'g') AS sequence, 0::INT AS first_index FROM part",
    "file_clustal": f"WITH {_ALN} SELECT name, (length(replace(substr(r, 1, c::INT + 1), '-', '')) - 1)::INT AS position, c::INT AS column FROM l WHERE substr(r, c::INT + 1, 1) <> '-'",
    "file_report": "SELECT n_nationkey::VARCHAR AS index, n_name AS name, n_regionkey::VARCHAR AS \"group\" FROM nation",
    "file_delimited": "SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance FROM customer",
    "file_csv": "SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, s_acctbal::VARCHAR AS s_acctbal FROM supplier",
    "file_tags": "SELECT p_partkey AS spec_idx, substr(p_brand, 1, 3) AS tag, p_size::DOUBLE AS before, p_size * 2.5::DOUBLE AS after, p_retailprice AS score FROM part",
    "file_graphviz": "SELECT printf('%d -- %d [label=\"%.3f\"];', l_orderkey, l_partkey, l_tax) AS line FROM lineitem",
    "file_html_report": "SELECT c_custkey, c_mktsegment FROM customer",
    "file_parameters": "SELECT 'BASE' AS name, 'x' AS value UNION ALL SELECT concat('KEY', n_nationkey::VARCHAR), concat('x/', n_name) FROM nation UNION ALL SELECT (n_nationkey % 3)::VARCHAR, string_agg(n_name, ';' ORDER BY n_nationkey) FROM nation GROUP BY 1",
    "set_append": with_views("SELECT spec_idx, frag_type, CASE WHEN frag_type = 'F' THEN charge ELSE -1 END AS charge, CASE WHEN frag_type = 'F' THEN 0 ELSE 1 END::INT AS set_no FROM spectra", "spectra"),
    "set_parts": with_views("SELECT count(*) AS n, 0::INT AS first_part, 7::INT AS last_part FROM spectra", "spectra"),
    "set_parallel": with_views("""WITH n AS (SELECT spec_idx, row_number() OVER (PARTITION BY frag_type ORDER BY spec_idx) AS position FROM spectra WHERE spec_idx IN (SELECT spec_idx FROM peaks)),
        p AS (SELECT position, mz, sum(intensity) AS i FROM peaks JOIN n USING (spec_idx) GROUP BY 1, 2), c AS (SELECT position, count(*) AS n_merged FROM n GROUP BY 1)
        SELECT position, n_merged, count(*)::INT AS n_peaks, round(sum(i), 2) AS total FROM p JOIN c USING (position) GROUP BY 1, 2""", "spectra", "peaks"),
    "set_extracted": with_views("SELECT spec_idx, charge, event_type AS note FROM spectra JOIN events ON spec_idx = event_id", "spectra"),
}
