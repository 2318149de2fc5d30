"""Writers. Each writes a folder of part files in Spark's way; the contents are plain files of the format."""

from __future__ import annotations

import base64
import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The header of the PSM table, in order, and the column that fills each (None: empty).
PSM_HEADER = {
    "#Scan#": "scan", "SpectrumFile": "spectrum_file", "Annotation": "annotation", "OrigAnnotation": "orig_annotation", "Protein": "protein", "dbIndex": "db_index", "numMods": "num_mods", "matchOrientation": None,
    "startMass": "start_mass", "Charge": "charge", "MQScore": "score", "p-value": "p_value", "isDecoy": "is_decoy", "StrictEnvelopeScore": None, "UnstrictEvelopeScore": None, "CompoundName": "compound_name",
    "Organism": "organism", "FileScanUniqueID": None, "FDR": "fdr", "LibraryName": None, "mzErrorPPM": None, "LibMetaData": None, "Smiles": None, "Inchi": None, "LibSearchSharedPeaks": None, "Abundance": None,
    "ParentMassDiff": None, "SpecMZ": "spec_mz", "ExactMass": "exact_mass", "LibrarySpectrumID": "library_id",
}

#: Size of the Arrow rows that go into one binary or XML file, and spectra of a text file that is read whole: files of a partition, so neither writer nor reader holds more.
FILE_BYTES, FILE_SPECTRA = 8 << 20, 10_000


def _peak_lines(form: str = "%s %s") -> Column:
    return F.array_join(F.transform("peaks", lambda p: F.format_string(form, p["mz"], p["intensity"])), "\n")


def mgf(spectra: DataFrame, path: str) -> None:
    """BEGIN IONS ... END IONS blocks."""
    meta = F.array_join(F.transform(F.array_sort(F.map_entries(F.coalesce("meta", F.create_map().cast("map<string,string>")))), lambda e: F.concat(F.upper(e["key"]), F.lit("="), e["value"], F.lit("\n"))), "") if "meta" in spectra.columns else F.lit("")
    head = F.concat(F.lit("BEGIN IONS\nSCANS="), F.col("scan").cast("string"), F.lit("\nPEPMASS="), F.col("parent_mz").cast("string"), F.lit("\nCHARGE="), F.coalesce("charge", F.lit(0)).cast("string"), F.lit("+\n"), meta)
    spectra.select(F.concat(head, _peak_lines(), F.lit("\nEND IONS\n")).alias("value")).write.text(path)


def ms2(spectra: DataFrame, path: str) -> None:
    """:scan blocks."""
    spectra.select(F.concat(F.lit(":"), F.col("scan").cast("string"), F.lit("\n"), F.col("parent_mass").cast("string"), F.lit(" "), F.coalesce("charge", F.lit(0)).cast("string"), F.lit("\n"), _peak_lines()).alias("value")).write.text(path)


def pkl(spectra: DataFrame, path: str) -> None:
    """Header and peaks, an empty line behind each spectrum."""
    head = F.concat_ws(" ", F.col("parent_mz").cast("string"), F.coalesce("precursor_intensity", F.lit(0.0)).cast("string"), F.coalesce("charge", F.lit(0)).cast("string"))
    spectra.select(F.concat(head, F.lit("\n"), _peak_lines(), F.lit("\n")).alias("value")).write.option("maxRecordsPerFile", FILE_SPECTRA).text(path)


def psm_table(psms: DataFrame, path: str) -> None:
    """The tab-separated PSM table; columns that the matches lack are empty."""
    psms.select(*[(F.col(c).cast("string") if c in psms.columns else F.lit("")).alias(h) for h, c in ((h, c or "") for h, c in PSM_HEADER.items())]).write.csv(path, sep="\t", header=True, emptyValue="")


def pairs_table(edges: DataFrame, path: str) -> None:
    """Tab-separated pairs, numbered from 1: shifts to 3 decimals, scores to 4."""
    component = F.col("component") if "component" in edges.columns else F.lit(-1)
    number = lambda c, n: F.format_string(f"%.{n}f", F.col(c).cast("double")).alias(c)
    edges.select((F.col("spec1") + 1).alias("spec1"), (F.col("spec2") + 1).alias("spec2"), number("shift1", 3), number("shift2", 3), number("score1", 4), number("score2", 4), (component + 1).alias("component")).write.csv(path, sep="\t")


def pairs_bytes(rows: list[tuple]) -> bytes:
    """One binary pair file of a few rows (spec1, spec2, shift1, shift2, score1, score2)."""
    x = np.array(rows, "<f4").reshape(-1, 6)
    x[:, :2] += 1
    return struct.pack("<I", len(x)) + x.tobytes()


def binary_spectra_bytes(rows: list[dict]) -> bytes:
    """One file of binary spectra, format version 3.1 (see sources.spectra_files)."""
    text = lambda xs: struct.pack("<I", len(xs)) + b"".join(struct.pack("<I", len(x)) + x for x in (s.encode() for s in xs))
    kinds = {"CID": 0, "ETD": 1, "HCD": 2, "PRM": 3}
    out = [struct.pack("<IbbI", 0, 3, 1, len(rows)), text(["version", "subversion"]), struct.pack("<HH", 3, 1)]
    for r in rows:
        peaks = r["peaks"] or []
        out.append(struct.pack("<Ihhh?i", max(r["scan"] or 0, 0), r.get("ms_level") or 2, kinds.get(r.get("frag_type"), 100), 0, False, 0) + text([r.get("file_name") or ""]))
        out.append(struct.pack("<ffhdfI", r.get("parent_mass") or 0, r.get("parent_mass_tol") or 0, r.get("charge") or 0, r.get("parent_mz") or 0, 0, len(peaks)))
        if peaks:
            out += [np.array([p[f] for p in peaks], "<f4").tobytes() for f in ("mz", "tol", "intensity")]
            out.append(struct.pack("<ff", r.get("retention_time") or 0, r.get("precursor_intensity") or 0))
    return b"".join(out)


def _binary_files(rows: DataFrame, path: str, extension: str, encode, most: int | None = FILE_BYTES) -> None:
    """A folder of files, encoded by the tasks and written through pyarrow's file systems: of each partition that has rows as many as take ``most`` bytes each (None: one). A task that runs again writes its files again."""
    from peakweave.session import ship

    ship(rows.sparkSession)

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        system, folder = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and "://" not in path else path if "://" in path else f"file://{path}")
        name = lambda n: f"{folder}/part-{TaskContext.get().partitionId():05d}{f'-{n:05d}' if n else ''}.{extension}"
        held, size, n = [], 0, 0

        def write() -> None:
            system.create_dir(folder)
            with system.open_output_stream(name(n)) as f:
                f.write(encode([x for b in held for x in b.to_pylist()]))

        for b in batches:
            # a slice's buffers are its batch's, so its share of them is counted
            step = b.num_rows if most is None else max(1, b.num_rows * most // max(1, b.nbytes))
            for at in range(0, b.num_rows, max(1, step)):
                part = b.slice(at, step)
                own = b.nbytes * part.num_rows // b.num_rows
                if held and most is not None and size + own > most:
                    write()
                    held, size, n = [], 0, n + 1
                held.append(part)
                size += own
        if held:
            write()
            n += 1
        # what an earlier attempt, which cut the rows otherwise, wrote beyond
        while n and system.get_file_info(name(n)).type != fs.FileType.NotFound:
            system.delete_file(name(n))
            n += 1
        yield from ()

    rows.mapInArrow(run, "done int").count()


def binary_spectra(spectra: DataFrame, path: str) -> None:
    """Binary spectra."""
    _binary_files(spectra, path, "pklbin", binary_spectra_bytes)


def pairs_binary(edges: DataFrame, path: str) -> None:
    """Binary pairs."""
    rows = edges.select("spec1", "spec2", "shift1", "shift2", "score1", "score2")
    _binary_files(rows, path, "bin", lambda held: pairs_bytes([tuple(r.values()) for r in held]))


def matrix(rows: DataFrame, path: str) -> None:
    """A binary matrix a partition, from equally long ``values`` in the order of row_no."""

    def encode(held: list[dict]) -> bytes:
        x = np.array([r["values"] for r in sorted(held, key=lambda r: r["row_no"])], "<f8")
        return struct.pack("<II", *x.shape) + x.tobytes()

    _binary_files(rows.select("row_no", "values"), path, "bin", encode, None)


def mzxml_bytes(rows: list[dict]) -> bytes:
    """One mzXML file, peaks as compressed 64-bit numbers."""
    out = ['<?xml version="1.0"?><mzXML><msRun>']
    for r in rows:
        xs = np.array([[p["mz"], p["intensity"]] for p in r["peaks"] or []], ">f8").tobytes()
        out.append(f'<scan num="{r["scan"]}" msLevel="{r.get("ms_level") or 2}" retentionTime="PT{r.get("retention_time") or 0}S"><precursorMz precursorCharge="{r.get("charge") or 0}" precursorIntensity="{r.get("precursor_intensity") or 0}">{r["parent_mz"]!r}</precursorMz>')
        out.append(f'<peaks precision="64" byteOrder="network" compressionType="zlib">{base64.b64encode(zlib.compress(xs)).decode()}</peaks></scan>')
    return "".join([*out, "</msRun></mzXML>"]).encode()


def mzml_bytes(rows: list[dict]) -> bytes:
    """One mzML file: level, precursor, retention time in seconds, and 64-bit arrays."""
    cv = lambda accession, value="", more="": f'<cvParam cvRef="MS" accession="{accession}" value="{value}"{more}/>'
    out = [f'<?xml version="1.0"?><mzML><run><spectrumList count="{len(rows)}">']
    for k, r in enumerate(rows):
        out.append(f'<spectrum index="{k}" id="scan={r["scan"]}">' + cv("MS:1000511", r.get("ms_level") or 2))
        out.append(cv("MS:1000016", r.get("retention_time") or 0, ' unitName="second"') + cv("MS:1000744", repr(r["parent_mz"])) + cv("MS:1000041", r.get("charge") or 0) + cv("MS:1000042", r.get("precursor_intensity") or 0))
        for field, kind in (("mz", "MS:1000514"), ("intensity", "MS:1000515")):
            data = base64.b64encode(np.array([p[field] for p in r["peaks"] or []], "<f8").tobytes()).decode()
            out.append(f"<binaryDataArray>{cv('MS:1000523')}{cv(kind)}<binary>{data}</binary></binaryDataArray>")
        out.append("</spectrum>")
    return "".join([*out, "</spectrumList></run></mzML>"]).encode()


def mzxml(spectra: DataFrame, path: str) -> None:
    """mzXML files."""
    _binary_files(spectra, path, "mzXML", mzxml_bytes)


def mzml(spectra: DataFrame, path: str) -> None:
    """mzML files."""
    _binary_files(spectra, path, "mzML", mzml_bytes)


def prms(spectra: DataFrame, path: str) -> None:
    """>> blocks of scored prefix masses."""
    head = F.concat(F.lit(">>SCAN "), F.col("scan").cast("string"), F.lit(" charge="), F.coalesce("charge", F.lit(0)).cast("string"), F.lit(" mass="), F.col("parent_mass").cast("string"), F.lit("\n"))
    spectra.select(F.concat(head, _peak_lines()).alias("value")).write.text(path)


def dta(spectra: DataFrame, path: str) -> None:
    """Blocks of mass and charge, then peaks, an empty line behind each."""
    spectra.select(F.concat(F.col("parent_mass").cast("string"), F.lit(" "), F.coalesce("charge", F.lit(0)).cast("string"), F.lit("\n"), _peak_lines(), F.lit("\n")).alias("value")).write.option("maxRecordsPerFile", FILE_SPECTRA).text(path)


def clusters(members: DataFrame, path: str) -> None:
    """Cluster text: a line ``name index size`` for each cluster, its members (file index, scan, m/z, charge) indented below. Clusters stand in the order of their index."""
    lines = members.groupBy("cluster_idx").agg(F.array_sort(F.collect_list(F.struct("file_idx", "scan", "parent_mz", "charge"))).alias("m"))
    body = F.array_join(F.transform("m", lambda x: F.concat(F.lit("\n\t"), F.concat_ws(" ", x["file_idx"].cast("string"), x["scan"].cast("string"), x["parent_mz"].cast("string"), x["charge"].cast("string")))), "")
    head = F.concat(F.lit("cluster "), F.col("cluster_idx").cast("string"), F.lit(" "), F.size("m").cast("string"))
    lines.orderBy("cluster_idx").select(F.concat(head, body).alias("value")).write.text(path)


def fasta(proteins: DataFrame, path: str) -> None:
    """>id description, then the sequence."""
    proteins.select(F.concat(F.lit(">"), F.concat_ws(" ", "id", F.when(F.col("description") != "", F.col("description"))), F.lit("\n"), "sequence").alias("value")).write.text(path)


def report(table: DataFrame, path: str) -> None:
    """Strings between semicolons, no header."""
    table.select(*[F.col(c).cast("string") for c in table.columns]).write.csv(path, sep=";")


def html(table: DataFrame, path: str, title: str = "", rows_per_page: int = 1000) -> None:
    """HTML pages of a table, so many rows each, in the order of the first column; pages are part files of a folder, and cells are escaped."""
    from peakweave.operators.spectra import renumbered

    escaped = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    row = F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *[escaped(c) for c in table.columns]), F.lit("</td></tr>"))
    numbered = renumbered(table, [table.columns[0]], "_no").select(F.floor((F.col("_no") - 1) / rows_per_page).alias("page"), "_no", row.alias("row"))
    pages = numbered.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_no", "row"))), lambda x: x["row"]), "").alias("rows"))
    head = f"<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>{title}</title></head><body><table><tr><th>{'</th><th>'.join(table.columns)}</th></tr>"
    pages.select(F.concat(F.lit(head), "rows", F.lit("</table></body></html>")).alias("value")).write.text(path)


def tags(rows: DataFrame, path: str) -> None:
    """Tab-separated tags."""
    rows.select("spec_idx", "tag", "before", "after", "score").write.csv(path, sep="\t")


def graphviz(edges: DataFrame, path: str, weight: str = "score1") -> None:
    """Edges as lines of an undirected graph."""
    edges.select(F.format_string('%d -- %d [label="%.3f"];', F.col("spec1"), F.col("spec2"), F.col(weight)).alias("value")).write.text(path)


WRITERS = {"pklbin": binary_spectra, "mgf": mgf, "ms2": ms2, "pkl": pkl, "prms": prms, "dta": dta, "mzxml": mzxml, "mzml": mzml, "parquet": lambda df, path: df.write.parquet(path)}


def write_spectra(spectra: DataFrame, path: str, kind: str) -> None:
    """By format name."""
    WRITERS[kind](spectra, path)
