"""Readers of result tables, protein databases, parameters and models."""

from __future__ import annotations

import re
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakweave.functions import peptide

#: Column -> type of the PSM table.
PSM = {
    "scan": "int", "spectrum_file": "string", "annotation": "string", "orig_annotation": "string", "protein": "string", "db_index": "int", "num_mods": "int", "charge": "int", "score": "double",
    "p_value": "double", "is_decoy": "boolean", "fdr": "double", "start_mass": "double", "spec_mz": "double", "exact_mass": "double", "compound_name": "string", "organism": "string", "library_id": "string",
}
#: Header names that stand for a column, lower case, compared after a leading # is cut.
ALIASES = {
    "scan": ["scan#", "scan", "scans", "scannum", "scan number", "scan(s)"],
    "spectrum_file": ["spectrumfile", "specfile", "filename", "spectrum file", "file"],
    "annotation": ["annotation", "peptide", "sequence", "peptide sequence"],
    "orig_annotation": ["origannotation", "original annotation"],
    "protein": ["protein", "proteins", "accession", "protein accession"],
    "db_index": ["dbindex", "protein index"],
    "num_mods": ["nummods", "mods"],
    "charge": ["charge", "z"],
    "score": ["mqscore", "score", "rawscore", "match score"],
    "p_value": ["p-value", "pvalue", "specprob", "spece-value", "specevalue", "probability", "e-value"],
    "is_decoy": ["isdecoy", "decoy"],
    "fdr": ["fdr", "qvalue", "q-value"],
    "start_mass": ["startmass"],
    "spec_mz": ["specmz", "precursor", "precursor m/z", "mz"],
    "exact_mass": ["exactmass"],
    "compound_name": ["compoundname", "compound name"],
    "organism": ["organism"],
    "library_id": ["libraryspectrumid", "filescanuniqueid"],
}
#: How result tables write modifications: (S,80), or with signs, S+80.
DIALECTS = ("bracketed", "signed")


def read_delimited(spark: SparkSession, path: str, sep: str = "\t", required: list[str] | None = None, schema: str | None = None, comment: str | None = None) -> DataFrame:
    """A table with a header (or, with a schema, without), checked for required columns."""
    read = spark.read.option("sep", sep).option("comment", comment) if comment else spark.read.option("sep", sep)
    out = read.schema(schema).csv(path) if schema else read.option("header", True).csv(path)
    if missing := [c for c in required or [] if c not in out.columns]:
        raise ValueError(f"{path} lacks the columns {missing}")
    return out


def read_psms(spark: SparkSession, path: str | list[str], dialect: str = "bracketed", zero_based: bool = False) -> DataFrame:
    """Matches of one or several files of one dialect. Known headers become typed columns, absent ones are null; zero-based scans are raised by one."""
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    by_alias = {re.sub(r"\s+", " ", c.strip().lower()).lstrip("#"): c for c in raw.columns}
    by_alias |= {k.rstrip("#"): v for k, v in by_alias.items()}
    found = {name: [by_alias[a.lstrip("#")] for a in aliases if a.lstrip("#") in by_alias] for name, aliases in ALIASES.items()}
    columns = []
    for name, kind in PSM.items():
        values = [F.expr(f"try_cast(`{c}` as {kind})") for c in dict.fromkeys(found.get(name, []))]
        columns.append((F.coalesce(*values) if values else F.lit(None).cast(kind)).alias(name))
    out = raw.select(*columns)
    if dialect not in DIALECTS:
        raise ValueError(f"no dialect {dialect}; there are {DIALECTS}")
    if dialect == "signed":
        out = out.withColumn("orig_annotation", F.coalesce("orig_annotation", "annotation")).withColumn("annotation", peptide.from_signed(F.col("annotation")))
    if zero_based:
        out = out.withColumn("scan", F.col("scan") + 1)
    decoy = F.coalesce(F.col("is_decoy"), F.col("protein").rlike("^(XXX|REV|DECOY)"), F.lit(False))
    return out.withColumn("is_decoy", decoy)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """db_index (position in its file's hash order is not used: rows are numbered by file and place), id, description, sequence."""
    raw = spark.read.text(path, lineSep=">").filter(F.trim("value") != "")
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    out = raw.select(F.regexp_extract(head, r"^(\S*)", 1).alias("id"), F.trim(F.regexp_extract(head, r"^\S*\s*(.*)$", 1)).alias("description"), F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"[^A-Za-z*]", "").alias("sequence"), F.monotonically_increasing_id().alias("_at"))
    from peakweave.operators.spectra import renumbered

    return renumbered(out, ["_at"], "db_index").select((F.col("db_index") - 1).cast("int").alias("db_index"), "id", "description", F.upper("sequence").alias("sequence"))


def read_clustal(spark: SparkSession, path: str) -> DataFrame:
    """name, position (from 0), column: where each residue of an aligned sequence stands."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"))
    part = lines.filter(F.col("value").rlike(r"^\S+\s+[A-Za-z-]+(\s+\d+)?\s*$")).filter(~F.col("value").rlike("^(CLUSTAL|MUSCLE)"))
    part = part.select(F.regexp_extract("value", r"^(\S+)", 1).alias("name"), F.regexp_extract("value", r"^\S+\s+([A-Za-z-]+)", 1).alias("piece"), "at")
    whole = part.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "").alias("row"))
    each = whole.select("name", "row", F.posexplode(F.split("row", "")).alias("column", "letter")).filter("letter NOT IN ('-', '')")
    return each.select("name", (F.length(F.regexp_replace(F.substr("row", F.lit(1), F.col("column") + 1), "-", "")) - 1).alias("position"), "column")


def read_report(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A report table: strings between semicolons, without a header."""
    return spark.read.csv(path, sep=";", schema=", ".join(f"`{c}` string" for c in columns))


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """spec_idx, tag, before, after, score from tab-separated lines."""
    return spark.read.csv(path, sep="\t", schema="spec_idx long, tag string, before double, after double, score double")


class Parameters(dict):
    """Text parameters with typed access. ``$NAME`` in a value stands for another parameter."""

    @classmethod
    def from_text(cls, text: str) -> Parameters:
        """key=value lines, split at the first =; lines without one are left out."""
        out = cls()
        for line in text.replace("\r", "").split("\n"):
            k, eq, v = line.partition("=")
            if eq:
                out[k] = v
        for k, v in out.items():
            out[k] = re.sub(r"\$([A-Za-z]+)", lambda m: out.get(m[1], m[0]), v)
        return out

    @classmethod
    def from_xml(cls, text: str) -> Parameters:
        """<parameter name="key">value</parameter> elements; repeated names are joined by semicolons."""
        out = cls()
        for e in ElementTree.fromstring(text).iter("parameter"):
            name, value = e.get("name", ""), (e.text or "").strip()
            out[name] = f"{out[name]};{value}" if name in out else value
        return out

    def number(self, name: str, default: float) -> float:
        """A number."""
        return float(self.get(name) or default)

    def flag(self, name: str, default: bool = False) -> bool:
        """1, true, yes or on."""
        return str(self[name]).strip().lower() in ("1", "true", "yes", "on") if name in self else default

    def choices(self, name: str) -> list[str]:
        """Parts between semicolons."""
        return [p for p in self.get(name, "").split(";") if p]

    def text(self) -> str:
        """Lines that from_text reads."""
        return "".join(f"{k}={v}\n" for k, v in self.items())


#: Names in workflow parameter files -> names here.
WORKFLOW_NAMES = {"tolerance.PM_tolerance": "TOLERANCE_PM", "tolerance.Ion_tolerance": "TOLERANCE_PEAK", "PAIRS_MIN_COSINE": "PAIRS_MIN_COSINE", "MIN_MATCHED_PEAKS": "MIN_MATCHED_PEAKS", "TOPK": "MAX_SPEC_PER_VARIANT", "MAXIMUM_COMPONENT_SIZE": "MAX_COMPONENT_SIZE", "FDR": "SPECTRUM_FDR"}


def from_workflow(xml: Parameters, names: dict[str, str] | None = None) -> Parameters:
    """Workflow parameters under the names used here; unknown ones keep theirs."""
    names = names or WORKFLOW_NAMES
    return Parameters({names.get(k, k): v for k, v in xml.items()})


def read_masses(text: str) -> dict[str, float]:
    """A count, then lines A=71.037."""
    lines = [x for x in text.splitlines() if x.strip()]
    out = {k.strip(): float(v) for k, _, v in (line.partition("=") for line in lines[1:])}
    if len(out) != int(lines[0]):
        raise ValueError(f"{lines[0]} masses announced, {len(out)} found")
    return out


def read_svm(text: str) -> dict:
    """A support vector model: gamma, rho, coefficients and vectors (keys from 1, absent ones 0)."""
    head, _, body = text.partition("SV\n")
    keys = dict(line.split(None, 1) for line in head.splitlines() if " " in line)
    rows = [line.split() for line in body.splitlines() if line.strip()]
    parsed = [(float(r[0]), {int(k): float(v) for k, v in (x.split(":") for x in r[1:])}) for r in rows]
    width = max((max(f, default=0) for _, f in parsed), default=0)
    return {"gamma": float(keys["gamma"]), "rho": float(keys["rho"].split()[0]), "coefficients": [c for c, _ in parsed], "vectors": [[f.get(i, 0.0) for i in range(1, width + 1)] for _, f in parsed]}


def read_ion_model(text: str) -> pd.DataFrame:
    """name, offset, charge, probability of ions, one a line."""
    rows = [line.split() for line in text.splitlines() if line.strip() and not line.startswith("#")]
    return pd.DataFrame([(r[0], float(r[1]), int(r[2]), float(r[3])) for r in rows if len(r) >= 4], columns=["name", "offset", "charge", "probability"])
