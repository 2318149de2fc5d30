"""Readers of spectrum files. Text formats are split into one row a spectrum by the record separator, so large files are read in parallel, and parsed in Arrow batches."""

from __future__ import annotations

import base64
import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakweave.functions.arrays import PROTON
from peakweave.session import ship

SCHEMA = "file_name string, scan int, ms_level int, frag_type string, parent_mass double, parent_mz double, parent_mass_tol double, charge int, retention_time double, precursor_intensity double, peaks array<struct<mz:double,intensity:double,tol:double>>, meta map<string,string>"
FIELDS = ("file_name", "scan", "ms_level", "frag_type", "parent_mass", "parent_mz", "parent_mass_tol", "charge", "retention_time", "precursor_intensity", "peaks", "meta")
#: Rows that a reader holds at a time: spectra, and rows of plain numbers.
SPECTRA, NUMBERS = 500, 10_000
#: MGF keys that are columns of their own; the rest goes to ``meta``.
_MGF_COLUMNS = {"SCANS", "PEPMASS", "PRECURSOR", "CHARGE", "MSLEVEL", "RTINSECONDS", "ACTIVATION", "PRECURSORINTENSITY"}


def _row(file_name: str, scan: int, peaks: list[tuple[float, float]], charge: int = 0, mz: float = 0.0, mass: float | None = None, **more) -> dict:
    out = dict.fromkeys(FIELDS)
    z = max(charge, 1)
    out |= {"file_name": file_name, "scan": scan, "ms_level": 2, "charge": charge, "parent_mz": mz, "parent_mass": mass if mass is not None else mz * z - (z - 1) * PROTON, "parent_mass_tol": 0.0, "meta": {}}
    out["peaks"] = [{"mz": m, "intensity": i, "tol": 0.0} for m, i in sorted(peaks)]
    return out | more


_KINDS = {"file_name": pa.string(), "scan": pa.int32(), "ms_level": pa.int32(), "frag_type": pa.string(), "charge": pa.int32(), "meta": pa.map_(pa.string(), pa.string())}


def _batches(rows: Iterable[dict]) -> Iterator[pa.RecordBatch]:
    """Spectra as Arrow, so many at a time; the rest of a file isn't held."""
    rows = iter(rows)
    while held := list(islice(rows, SPECTRA)):
        ends = pa.array(np.cumsum([0, *(len(r["peaks"]) for r in held)]), pa.int32())
        fields = [pa.array([p[f] for r in held for p in r["peaks"]], pa.float64()) for f in ("mz", "intensity", "tol")]
        peaks = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, names=["mz", "intensity", "tol"]))
        columns = {f: pa.array([list(r[f].items()) if f == "meta" else r[f] for r in held], _KINDS.get(f, pa.float64())) for f in FIELDS if f != "peaks"}
        yield pa.RecordBatch.from_arrays([peaks if f == "peaks" else columns[f] for f in FIELDS], names=list(FIELDS))


def _blocks(text: str) -> Iterator[str]:
    """What lies between empty lines."""
    at = 0
    for m in re.finditer(r"\n\s*\n", text):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:]


def _numbers(line: str) -> list[float]:
    try:
        return [float(x) for x in line.split()]
    except ValueError:
        return []


def parse_mgf(text: str, file_name: str) -> dict | None:
    """One BEGIN IONS block."""
    if "BEGIN IONS" not in text:
        return None
    keys: dict[str, str] = {}
    peaks = []
    for line in text.split("BEGIN IONS", 1)[1].splitlines():
        line = line.strip()
        if not line:
            continue
        if not "0" <= line[0] <= "9" and re.match(r"[A-Za-z_]+\d*=", line):
            k, _, v = line.partition("=")
            keys[k.upper()] = v.strip()
        elif (x := _numbers(line)) and len(x) >= 2:
            peaks.append((x[0], x[1]))
    mass = _numbers(keys.get("PEPMASS", keys.get("PRECURSOR", "0"))) or [0.0]
    charge = re.match(r"[+-]?(\d+)([+-]?)", keys.get("CHARGE", "0"))
    meta = {k.lower(): v for k, v in keys.items() if k not in _MGF_COLUMNS}
    intensity = _numbers(keys.get("PRECURSORINTENSITY", "")) or mass[1:2]
    scan = re.match(r"\d+", keys.get("SCANS", ""))
    return _row(keys.get("FILENAME", file_name), int(scan[0]) if scan else -1, peaks, int(charge[1]) if charge else 0, mass[0], ms_level=int(keys.get("MSLEVEL", 2) or 2), frag_type=keys.get("ACTIVATION"), retention_time=(_numbers(keys.get("RTINSECONDS", "").rstrip("sS")) or [None])[0], precursor_intensity=intensity[0] if intensity else None, meta=meta)


def parse_pkl(text: str, file_name: str) -> dict | None:
    """A header of m/z, intensity and charge, then peaks."""
    lines = [x for x in (_numbers(line) for line in text.splitlines()) if x]
    if not lines or len(lines[0]) < 3:
        return None
    mz, intensity, charge = lines[0][:3]
    return _row(file_name, -1, [(x[0], x[1]) for x in lines[1:] if len(x) > 1], int(charge), mz, precursor_intensity=intensity)


def parse_pkl_mic(text: str, file_name: str) -> dict | None:
    """As PKL, but every charge weighs 1 in the header's mass, and only one proton counts."""
    row = parse_pkl(text, file_name)
    return row and row | {"parent_mass": row["parent_mz"] * row["charge"] - row["charge"] + PROTON if row["charge"] > 0 else row["parent_mz"], "precursor_intensity": None}


def parse_dta(text: str, file_name: str) -> dict | None:
    """Singly protonated mass and charge, then peaks."""
    lines = [x for x in (_numbers(line) for line in text.splitlines()) if x]
    if not lines or len(lines[0]) < 2:
        return None
    mass, z = lines[0][0], int(lines[0][1])
    return _row(file_name, -1, [(x[0], x[1]) for x in lines[1:] if len(x) > 1], z, (mass + (max(z, 1) - 1) * PROTON) / max(z, 1), mass)


def parse_ms2(text: str, file_name: str) -> dict | None:
    """A block headed by ``:scan`` (or ``:first.last.charge``), then mass and charge, then peaks."""
    lines = text.strip().splitlines()
    if not lines:
        return None
    scan = re.match(r":?\s*(\d+)", lines[0])
    head = _numbers(lines[1]) if len(lines) > 1 else []
    if not scan or len(head) < 2:
        return None
    mass, z = head[0], int(head[1])
    return _row(file_name, int(scan[1]), [(x[0], x[1]) for x in map(_numbers, lines[2:]) if len(x) > 1], z, (mass + (max(z, 1) - 1) * PROTON) / max(z, 1), mass)


def parse_prms(text: str, file_name: str) -> dict | None:
    """``>>`` blocks of scored prefix masses: a title line with the number, then (optionally) charge and mass, then mass and score."""
    lines = text.strip().splitlines()
    if not lines:
        return None
    number = re.search(r"\d+", lines[0])
    keys = dict(re.findall(r"([A-Za-z_]+)[=:]\s*([-\d.]+)", "\n".join(lines[:3])))
    peaks = [(x[0], x[1]) for x in map(_numbers, lines[1:]) if len(x) > 1]
    mass = float(keys.get("mass", keys.get("PM", peaks[-1][0] + 19.01784115 if peaks else 0)))
    return _row(file_name, int(number[0]) if number else -1, peaks, int(float(keys.get("charge", 0))), mass, mass, frag_type="PRM", meta={"title": lines[0].strip()})


def _text_reader(parse: Callable, separator: str | None) -> Callable:
    def read(spark: SparkSession, path: str) -> DataFrame:
        ship(spark)
        rows = spark.read.text(path, lineSep=separator) if separator else spark.read.text(path, wholetext=True)
        rows = rows.select("value", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file_name"))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = ((v.as_py(), f.as_py()) for v, f in zip(b.column(0), b.column(1), strict=True))
                pieces = texts if separator else ((p, f) for v, f in texts for p in _blocks(v))
                yield from _batches(r for v, f in pieces if (r := parse(v, f)))

        return rows.mapInArrow(run, SCHEMA)

    return read


read_mgf = _text_reader(parse_mgf, "END IONS")
read_pkl = _text_reader(parse_pkl, None)
read_pkl_mic = _text_reader(parse_pkl_mic, None)
read_dta = _text_reader(parse_dta, None)
read_ms2 = _text_reader(lambda v, f: parse_ms2(v, f), "\n:")
read_prms = _text_reader(lambda v, f: parse_prms(v, f), "\n>>")


def _binary(spark: SparkSession, path: str, parse: Callable, schema: str) -> DataFrame:
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("content", F.element_at(F.split("path", "/"), -1).alias("file_name"))

    if schema == SCHEMA:
        return files.mapInArrow(lambda batches: _batches(r for b in batches for c, f in zip(b.column(0), b.column(1), strict=True) for r in parse(c.as_py(), f.as_py())), schema)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content, name in zip(b["content"], b["file_name"], strict=True):
                rows = iter(parse(bytes(content), name))
                while held := list(islice(rows, NUMBERS)):
                    yield pd.DataFrame(held, columns=names)

    return files.mapInPandas(run, schema)


def decode_peaks(text: str, precision: int, compressed: bool, big: bool = True) -> np.ndarray:
    """base64 numbers of an XML file."""
    raw = base64.b64decode("".join(text.split()))
    raw = zlib.decompress(raw) if compressed else raw
    return np.frombuffer(raw, f"{'>' if big else '<'}f{precision // 8}").astype(float)


def parse_mzxml(content: bytes, file_name: str) -> Iterator[dict]:
    """Scans of an mzXML file, streamed; nested scans are rows of their own."""
    import io
    from xml.etree import ElementTree

    local = lambda e: e.tag.rsplit("}", 1)[-1]
    for _, e in ElementTree.iterparse(io.BytesIO(content)):
        if local(e) != "scan":
            continue
        children = {local(c): c for c in e}
        peaks, pre = children.get("peaks"), children.get("precursorMz")
        xs = decode_peaks(peaks.text or "", int(peaks.get("precision", 32)), peaks.get("compressionType") == "zlib") if peaks is not None else np.zeros(0)
        rt = re.match(r"PT([\d.]+)S", e.get("retentionTime", ""))
        yield _row(file_name, int(e.get("num", -1)), list(zip(xs[::2].tolist(), xs[1::2].tolist(), strict=False)), int(pre.get("precursorCharge", 0)) if pre is not None else 0, float(pre.text) if pre is not None and pre.text else 0.0, ms_level=int(e.get("msLevel", 1)), frag_type=pre.get("activationMethod") if pre is not None else None, retention_time=float(rt[1]) if rt else None, precursor_intensity=float(pre.get("precursorIntensity", 0)) if pre is not None else None)
        for c in list(e):
            if local(c) != "scan":
                e.remove(c)


def parse_mzml(content: bytes, file_name: str) -> Iterator[dict]:
    """Spectra of an mzML file, by the accessions of the public vocabulary."""
    import io
    from xml.etree import ElementTree

    # fixed values: accessions of the vocabulary
    level, selected, charge, height, start = "MS:1000511", "MS:1000744", "MS:1000041", "MS:1000042", "MS:1000016"
    mz_array, doubles, packed = "MS:1000514", "MS:1000523", "MS:1000574"
    kinds = {"MS:1000133": "CID", "MS:1000422": "HCD", "MS:1000598": "ETD"}
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    for _, e in ElementTree.iterparse(io.BytesIO(content)):
        if local(e) != "spectrum":
            continue
        params, arrays = {}, {}
        for x in e.iter():
            if local(x) == "cvParam":
                params.setdefault(x.get("accession"), x)
            elif local(x) == "binaryDataArray":
                own = {c.get("accession") for c in x if local(c) == "cvParam"}
                data = next((c.text or "" for c in x if local(c) == "binary"), "")
                arrays["mz" if mz_array in own else "i"] = decode_peaks(data, 64 if doubles in own else 32, packed in own, big=False)
        number = re.search(r"scan=(\d+)", e.get("id", "")) or re.search(r"(\d+)$", e.get("id", ""))
        get = lambda a, d=0.0: float(params[a].get("value") or d) if a in params else d
        minutes = a.get("unitName", "minute") == "minute" if (a := params.get(start)) is not None else True
        yield _row(file_name, int(number[1]) if number else -1, list(zip(arrays.get("mz", np.zeros(0)).tolist(), arrays.get("i", np.zeros(0)).tolist(), strict=False)), int(get(charge)), get(selected), ms_level=int(get(level, 1)), frag_type=next((k for a, k in kinds.items() if a in params), None), retention_time=get(start) * (60 if minutes else 1), precursor_intensity=get(height))
        e.clear()


def read_mzxml(spark: SparkSession, path: str) -> DataFrame:
    """mzXML files, one task a file."""
    return _binary(spark, path, parse_mzxml, SCHEMA)


def read_mzml(spark: SparkSession, path: str) -> DataFrame:
    """mzML files, one task a file."""
    return _binary(spark, path, parse_mzml, SCHEMA)


#: Fragmentation types of the binary format, by number.
FRAGMENT = {0: "CID", 1: "ETD", 2: "HCD", 3: "PRM", 100: "NONE"}


def parse_binary_spectra(content: bytes, file_name: str) -> Iterator[dict]:
    """Binary spectra, format version 3: an empty integer, version and subversion, the count, names and numbers of versions, then each spectrum.

    A spectrum: scan, level, fragmentation, analyser, reversed flag, file index, file names, masses, charge, m/z, energy, the number of
    peaks, and (if any) their masses, tolerances and intensities, then retention time and precursor intensity.
    """
    at = 0

    def take(form: str) -> tuple:
        nonlocal at
        out = struct.unpack_from("<" + form, content, at)
        at += struct.calcsize("<" + form)
        return out

    def strings() -> list[str]:
        nonlocal at
        out = []
        for _ in range(take("I")[0]):
            n = take("I")[0]
            out.append(content[at : at + n].decode("utf-8", "replace"))
            at += n
        return out

    empty, version, _, count = take("IbbI")
    if empty or version != 3:
        raise ValueError(f"{file_name}: binary spectra of version {version} aren't supported")
    take(f"{len(strings())}H")
    for _ in range(count):
        scan, level, fragment, _, _, _ = take("Ihhh?i")
        names = strings()
        mass, tol, charge, mz, _ = take("ffhdf")
        n = take("I")[0]
        xs = [np.frombuffer(content, "<f4", n, at + 4 * n * k).astype(float).tolist() for k in range(3)]
        at += 12 * n
        rt, intensity = take("ff") if n else (None, None)
        row = _row(names[0] if names and names[0] else file_name, scan, [], charge, mz, mass, ms_level=level, frag_type=FRAGMENT.get(fragment), parent_mass_tol=tol, retention_time=rt, precursor_intensity=intensity)
        row["peaks"] = [{"mz": m, "intensity": i, "tol": t} for m, t, i in zip(*xs, strict=True)]
        yield row


def read_binary_spectra(spark: SparkSession, path: str) -> DataFrame:
    """Binary spectra, one task a file."""
    return _binary(spark, path, parse_binary_spectra, SCHEMA)


def parse_pairs(content: bytes, _: str) -> Iterator[tuple]:
    """A count, then six 32-bit floats a pair: spectra (from 1 on disk, from 0 in memory), shifts, scores."""
    n = struct.unpack("<I", content[:4])[0]
    rows = np.frombuffer(content, "<f4", 6 * n, 4).reshape(n, 6)
    for at in range(0, n, NUMBERS):
        for r in rows[at : at + NUMBERS].astype(float).tolist():
            yield int(r[0]) - 1, int(r[1]) - 1, *r[2:]


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Binary pair files."""
    return _binary(spark, path, parse_pairs, "spec1 long, spec2 long, shift1 double, shift2 double, score1 double, score2 double")


def read_pairs_text(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated pairs, numbered from 1, the component last."""
    raw = spark.read.csv(path, sep="\t", schema="spec1 long, spec2 long, shift1 double, shift2 double, score1 double, score2 double, component long")
    return raw.withColumns({c: F.col(c) - 1 for c in ("spec1", "spec2", "component")})


def parse_matrix(content: bytes, _: str) -> Iterator[tuple]:
    """Rows and columns as 32-bit integers, then doubles by row."""
    n, m = struct.unpack("<II", content[:8])
    for k, r in enumerate(np.frombuffer(content, "<f8", n * m, 8).reshape(n, m).tolist()):
        yield k, r


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Binary matrices: row_no and values."""
    return _binary(spark, path, parse_matrix, "row_no long, values array<double>")


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """Cluster text: a line ``name index n ...`` opens a cluster, tab-indented lines are members (file index, scan, ...). cluster_idx, file_idx, scan, parent_mz, charge."""
    ship(spark)
    rows = spark.read.text(path, wholetext=True)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text in b["value"]:
                place = -1  # clusters without a number are numbered by their place in the file
                for line in text.splitlines():
                    x = line.split()
                    if line[:1] in "\t " and x:
                        out.append((now, int(x[0]), int(x[1]), float(x[2]) if len(x) > 2 else None, int(float(x[3])) if len(x) > 3 else None))
                    elif x:
                        place += 1
                        now = int(x[1]) if len(x) > 2 and x[1].isdigit() else place
            yield pd.DataFrame(out, columns=["cluster_idx", "file_idx", "scan", "parent_mz", "charge"])

    return rows.mapInPandas(run, "cluster_idx int, file_idx int, scan int, parent_mz double, charge int")


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "mgf": read_mgf, "pkl": read_pkl, "mic": read_pkl_mic, "dta": read_dta, "ms2": read_ms2, "prms": read_prms, "prmsv3": read_prms, "mzxml": read_mzxml, "mzml": read_mzml, "pklbin": read_binary_spectra,
    "parquet": lambda spark, path: spark.read.parquet(path),
}


def read_spectra(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Spectra of a file, folder, glob or comma-separated list, by format name or extension."""
    kind = (kind or path.rstrip("/*").rsplit(".", 1)[-1]).lower()
    if kind not in READERS:
        raise ValueError(f"no reader for {kind}; there are {', '.join(READERS)}")
    paths = [p.strip() for p in path.split(",")]
    out = READERS[kind](spark, paths[0])
    for p in paths[1:]:
        out = out.unionByName(READERS[kind](spark, p))
    return out


def by_scan(spectra: DataFrame, first: int, last: int | None = None) -> DataFrame:
    """A scan, or a range of them; on Parquet the bounds reach the scan."""
    return spectra.filter(F.col("scan").between(first, first if last is None else last))


def listed(spark: SparkSession, path: str) -> list[str]:
    """The paths in a text file that names one a line (lines that begin with # left out), or in a text with several between semicolons."""
    if path.endswith((".txt", ".lst", ".list")):
        lines = [r["value"].strip() for r in spark.read.text(path).collect()]  # a list of files, read on the driver
        return [x for x in lines if x and not x.startswith("#")]
    return [p.strip() for p in path.split(";") if p.strip()]


def read_project(spark: SparkSession, folder: str, names: tuple[str, ...] = ("spectra", "psms", "edges", "clusters", "contigs", "proteins")) -> dict[str, DataFrame]:
    """The tables of a project folder that are there, by name."""
    out = {}
    for name in names:
        try:
            out[name] = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return out
