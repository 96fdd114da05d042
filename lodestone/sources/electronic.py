"""Band structures, densities of states and planar fields from text files of simulation codes, as rows. Read by Spark's own reader, parsed in Arrow batches;
what a file's name says (spin, site, kind, orbital) becomes columns. Files that can't be read give one row with `problem`."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestone.functions.quantities import UNITS
from lodestone.sources.files import _files

HARTREE = UNITS["energy"]["hartree"]
BANDS = pa.schema([("path", pa.string()), ("spin", pa.string()), ("band", pa.int32()), ("k_idx", pa.int32()), ("kx", pa.float64()), ("ky", pa.float64()), ("kz", pa.float64()), ("energy", pa.float64()), ("occ", pa.float64()), ("problem", pa.string())])
BANDS_DDL = "path string, spin string, band int, k_idx int, kx double, ky double, kz double, energy double, occ double, problem string"
DOS = pa.schema([("path", pa.string()), ("kind", pa.string()), ("site", pa.int32()), ("spin", pa.string()), ("orbital", pa.string()), ("energy", pa.float64()), ("value", pa.float64()), ("e_fermi", pa.float64()), ("problem", pa.string())])
DOS_DDL = "path string, kind string, site int, spin string, orbital string, energy double, value double, e_fermi double, problem string"
ORBITALS = "spdfghi"


def _lenient(x: str) -> float:
    try:
        return float(x)
    except ValueError:
        return 0.0


def aims_bands(text: str, path: str) -> Iterator[dict]:
    """band<spin><segment>.out: k-point, then occupation and energy of every band. k_idx counts within the file; files of a path follow by name."""
    m = re.search(r"band(\d)(\d+)\.out", path)
    spin = {"1": "up", "2": "down"}.get(m[1] if m else "1", "up")
    for k, line in enumerate(r for r in text.splitlines() if r.strip()):
        v = [float(x) for x in line.split()]
        if len(v) < 6 or len(v) % 2:
            raise ValueError(f"line {k + 1}: a number, a k-point and pairs of occupation and energy are expected")
        for b in range((len(v) - 4) // 2):
            yield {"spin": spin, "band": b, "k_idx": k, "kx": v[1], "ky": v[2], "kz": v[3], "occ": v[4 + 2 * b], "energy": v[5 + 2 * b]}


def qe_bands(text: str, path: str) -> Iterator[dict]:
    """bands.dat: a header with the number of bands, then each k-point and its energies over as many lines as they need."""
    head, _, rest = text.partition("/")
    m = re.search(r"nbnd\s*=\s*(\d+)", head)
    if not m:
        raise ValueError("the header states no number of bands")
    n, v = int(m[1]), [float(x) for x in rest.split()]
    if len(v) % (n + 3):
        raise ValueError(f"{len(v)} numbers don't make k-points of {n} bands")
    for k in range(len(v) // (n + 3)):
        row = v[k * (n + 3) : (k + 1) * (n + 3)]
        for b in range(n):
            yield {"spin": None, "band": b, "k_idx": k, "kx": row[0], "ky": row[1], "kz": row[2], "energy": row[3 + b], "occ": None}


def cp2k_bands(text: str, path: str) -> Iterator[dict]:
    """.bs: 'Point i Spin s: x y z' headers followed by band, energy and occupation. k-points are counted for each spin."""
    k: dict[str, int] = {}
    where, spin = None, "1"
    for line in text.splitlines():
        m = re.match(r"#\s*Point\s+\d+\s+Spin\s+(\d+)\s*:\s*(.*)", line)
        if m:
            spin, where = m[1], [float(x) for x in m[2].split()[:3]]
            k[spin] = k.get(spin, -1) + 1
        elif line.strip() and not line.startswith("#") and where is not None:
            r = line.split()
            yield {"spin": {"1": "up", "2": "down"}.get(spin, spin), "band": int(r[0]) - 1, "k_idx": k[spin], "kx": where[0], "ky": where[1], "kz": where[2], "energy": float(r[1]), "occ": float(r[2]) if len(r) > 2 else None}


def _columns(text: str) -> Iterator[list[str]]:
    return (r.split() for r in text.splitlines() if r.strip() and not r.lstrip().startswith("#"))


def aims_total_dos(text: str, path: str) -> Iterator[dict]:
    """Energy and one column a spin."""
    for r in _columns(text):
        for i, x in enumerate(r[1:]):
            yield {"orbital": "total", "spin": None if len(r) == 2 else ("up", "down")[i], "energy": float(r[0]), "value": float(x)}


def aims_projected_dos(text: str, path: str) -> Iterator[dict]:
    """atom_proj…_<kind><site>: energy, total and one column for each angular momentum."""
    m = re.search(r"atom_proj(?:ected)?_dos_(?:spin_(up|dn))?_?([A-Za-z_]+?)(\d{4})", path)
    if not m:
        raise ValueError("the file's name states no site")
    for r in _columns(text):
        for name, x in zip(["total", *ORBITALS], r[1:]):
            yield {"kind": m[2], "site": int(m[3]) - 1, "spin": {"up": "up", "dn": "down"}.get(m[1]), "orbital": name, "energy": float(r[0]), "value": float(x)}


def qe_total_dos(text: str, path: str) -> Iterator[dict]:
    m = re.search(r"EFermi\s*=\s*([-+.\dEe]+)", text)
    for r in _columns(text):
        spins = [None] if len(r) == 3 else ["up", "down"]
        for s, x in zip(spins, r[1:]):
            yield {"orbital": "total", "spin": s, "energy": float(r[0]), "value": _lenient(x), "e_fermi": float(m[1]) if m else None}


def qe_projected_dos(text: str, path: str) -> Iterator[dict]:
    """….pdos_atm#<site>(<kind>)_wfc#<n>(<orbital>): energy, local sums, then the components; numbers that can't be read count as 0."""
    m = re.search(r"pdos_atm#(\d+)\((\w+?)\)_wfc#\d+\((\w)", path.replace("%23", "#").replace("%28", "(").replace("%29", ")"))
    if not m:
        raise ValueError("the file's name states no site")
    head = text.splitlines()[0] if text else ""
    polarised = "ldosup" in head.replace(" ", "")
    for r in _columns(text):
        for spin, x in zip(("up", "down") if polarised else (None,), r[1:]):
            yield {"kind": m[2], "site": int(m[1]) - 1, "spin": spin, "orbital": m[3], "energy": float(r[0]), "value": _lenient(x)}


def cp2k_projected_dos(text: str, path: str) -> Iterator[dict]:
    """.pdos: states with their occupation and projections; energies come out in eV, one value an orbital component."""
    head = text.splitlines()
    m = re.search(r"atomic kind (\S+)|list (\d+)", head[0])
    e = re.search(r"E\(Fermi\)\s*=\s*([-.\d]+)", head[0])
    spin = "up" if "ALPHA" in path else "down" if "BETA" in path else None
    names = head[1].split("Occupation")[-1].split()
    for r in _columns(text):
        for name, x in zip(names, r[3:]):
            yield {"kind": (m[1] or m[2]) if m else None, "spin": spin, "orbital": name, "energy": float(r[1]) * HARTREE, "value": float(x), "e_fermi": float(e[1]) * HARTREE if e else None}


BAND_FORMATS: dict[str, tuple[str, Callable]] = {"aims": ("band[0-9]*.out", aims_bands), "qe": ("*bands*.dat", qe_bands), "cp2k": ("*.bs", cp2k_bands)}
DOS_FORMATS: dict[str, tuple[str, Callable]] = {
    "aims_total": ("KS_DOS_total*.dat*", aims_total_dos), "aims_projected": ("atom_proj*_dos*", aims_projected_dos), "qe_total": ("*.dos", qe_total_dos),
    "qe_projected": ("*pdos_atm*", qe_projected_dos), "cp2k_projected": ("*.pdos", cp2k_projected_dos),
}


def _run(parse: Callable, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows: list[dict] = []
                try:
                    for r in parse((content or b"").decode("utf-8", "replace"), path):
                        rows.append(r | {"path": path})
                        if len(rows) == 20_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                except (ValueError, IndexError) as e:
                    rows.append({"path": path, "problem": str(e) or type(e).__name__})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def read_bands(spark: SparkSession, path: str, code: str, pattern: str | None = None) -> DataFrame:
    """Rows of BANDS from a folder, file or glob; code: a key of BAND_FORMATS. Energies are in eV, as the files give them."""
    names, parse = BAND_FORMATS[code]
    return _files(spark, path, pattern or names).mapInArrow(_run(parse, BANDS), BANDS_DDL)


def read_dos(spark: SparkSession, path: str, kind: str, pattern: str | None = None) -> DataFrame:
    """Rows of DOS from a folder, file or glob; kind: a key of DOS_FORMATS."""
    names, parse = DOS_FORMATS[kind]
    return _files(spark, path, pattern or names).mapInArrow(_run(parse, DOS), DOS_DDL)


PLANE = pa.schema([("path", pa.string()), ("x", pa.float64()), ("y", pa.float64()), ("field", pa.string()), ("value", pa.float64()), ("problem", pa.string())])


def critic2_plane(text: str, path: str) -> Iterator[dict]:
    """Planar fields: coordinates in columns 4 and 5, fields from column 6 on."""
    head = next((r for r in text.splitlines() if r.startswith("#") and len(r.split()) > 6), "")
    names = head.lstrip("# ").split()[5:]
    for r in _columns(text):
        for i, v in enumerate(r[5:]):
            yield {"x": float(r[3]), "y": float(r[4]), "field": names[i] if i < len(names) else f"field_{i + 1}", "value": float(v)}


def read_planes(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    return _files(spark, path, pattern).mapInArrow(_run(critic2_plane, PLANE), "path string, x double, y double, field string, value double, problem string")


SETS = pa.schema([("path", pa.string()), ("set", pa.int32()), ("colour", pa.string()), ("place", pa.int32()), ("x", pa.float64()), ("y", pa.float64()), ("problem", pa.string())])


def xmgrace_sets(text: str, path: str) -> Iterator[dict]:
    """.agr: the points of every set, with the colour its line has."""
    colours = dict(re.findall(r"(?m)^@\s*s(\d+)\s+line color\s+(\S+)", text))
    at, place = -1, 0
    for line in text.splitlines():
        m = re.match(r"@target\s+G\d+\.S(\d+)", line, re.I)
        if m:
            at, place = int(m[1]), 0
        elif at >= 0 and re.match(r"\s*[-+.\d]", line):
            r = line.split()
            yield {"set": at, "colour": colours.get(str(at)), "place": place, "x": float(r[0]), "y": float(r[1])}
            place += 1


def read_xmgrace(spark: SparkSession, path: str) -> DataFrame:
    return _files(spark, path, "*.agr").mapInArrow(_run(xmgrace_sets, SETS), "path string, set int, colour string, place int, x double, y double, problem string")


def patterns(text: str, wanted: dict[str, str]) -> dict[str, str | None]:
    """The last match of each pattern's first group in a text."""
    return {k: (re.findall(p, text) or [None])[-1] for k, p in wanted.items()}


def read_patterns(spark: SparkSession, path: str, wanted: dict[str, str], pattern: str | None = None) -> DataFrame:
    """(path, name, value): the last match of each pattern in every file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, k, v) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, v in patterns((c or b"").decode("utf-8", "replace"), wanted).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["path", "name", "value"])

    return _files(spark, path, pattern).mapInArrow(run, "path string, name string, value string")
