"""Structure file formats: texts to structures and structures to text. Every parser yields one dict a structure and raises ValueError, with its place, where the
text is broken; what came before is kept. Positions are angstrom unless is_cartesian is False."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np

from lodestone.functions.formula import parse_formula
from lodestone.functions.formula_columns import reduce_quantities
from lodestone.functions.quantities import UNITS
from lodestone.operators.crystals import NUMBER, SYMBOLS, atomic_number

BOHR = UNITS["length"]["bohr"]
HARTREE = UNITS["energy"]["hartree"]


def typed(value: str) -> bool | int | float | str:
    """'yes' and 'true' are True, 'no' and 'false' False, whole and decimal numbers (uncertainties in brackets dropped) numbers, anything else text."""
    v = value.strip()
    low = v.lower()
    if low in ("yes", "true", ".true."):
        return True
    if low in ("no", "false", ".false."):
        return False
    if re.fullmatch(r"[+-]?\d+", v):
        return int(v)
    if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eEdD][+-]?\d+)?(\(\d+\))?", v):
        return float(re.sub(r"\(\d+\)$", "", v).replace("d", "e").replace("D", "e"))
    return v


def _symbol(label: str) -> str:
    """Element of a label or number: 'Fe1', 'fe', '26'."""
    if label.strip().isdigit():
        return SYMBOLS[int(label) - 1]
    m = re.match(r"[A-Za-z]+", label.strip())
    if m:
        for n in (2, 1):
            s = m[0][:n].capitalize()
            if len(m[0]) >= n and s in NUMBER:
                return s
    raise ValueError(f"{label!r} names no element")


def _vectors(lines: list[list[str]], factor: float = 1.0) -> list[list[float]]:
    out = [[float(x.replace("d", "e").replace("D", "e")) * factor for x in r[:3]] for r in lines]
    if any(len(r) != 3 for r in out):
        raise ValueError("a vector has three numbers")
    return out


# extended XYZ

_PAIR = re.compile(r"""([^\s=]+)\s*=\s*("[^"]*"|'[^']*'|\{[^}]*\}|\[[^\]]*\]|\S+)""")


def comment_fields(line: str) -> dict[str, str]:
    """key=value pairs of a comment line; values may stand in quotes, braces or brackets."""
    return {k: v.strip("\"'{}[]") for k, v in _PAIR.findall(line)}


def parse_xyz(text: str) -> Iterator[dict]:
    lines = text.splitlines()
    at = 0
    while at < len(lines):
        if not lines[at].strip():
            at += 1
            continue
        begin = at + 1
        try:
            n = int(lines[at])
            comment, body = lines[at + 1], [r.split() for r in lines[at + 2 : at + 2 + n]]
        except (ValueError, IndexError):
            raise ValueError(f"line {begin}: a frame begins with its number of sites and a comment") from None
        at += 2 + n
        if len(body) < n:
            raise ValueError(f"line {begin}: the frame of {n} sites ends too early")
        out: dict = {"attributes": {}, "site_attributes": {}, "pbc": [False] * 3}
        columns = [("species", 1), ("pos", 3)]
        fields = comment_fields(comment)
        if not fields and comment.strip():
            out["attributes"]["comment"] = comment.strip()
        for k, v in fields.items():
            if k.lower() == "lattice":
                out["cell"] = _vectors([v.split()[i : i + 3] for i in (0, 3, 6)])
                if len(v.split()) != 9:
                    raise ValueError(f"line {begin}: a lattice has nine numbers")
                out["pbc"] = [True] * 3 if "pbc" not in map(str.lower, fields) else out["pbc"]
            elif k.lower() == "pbc":
                out["pbc"] = [x.lower().startswith(("t", "1")) for x in v.split()]
                if len(out["pbc"]) != 3:
                    raise ValueError(f"line {begin}: pbc has three flags")
            elif k.lower() == "properties":
                p = v.split(":")
                if len(p) % 3:
                    raise ValueError(f"line {begin}: Properties has three entries a column")
                columns = [(p[i], int(p[i + 2])) for i in range(0, len(p), 3)]
            elif k.lower() == "label":
                out["label"] = v
            else:
                out["attributes"][k] = v
        width, place = sum(w for _, w in columns), {}
        for k, w in columns:
            place[k] = (sum(x for _, x in columns[: [c for c, _ in columns].index(k)]), w)
        try:
            if any(len(r) < width for r in body):
                raise ValueError("a site has too few columns")
            s, p = place["species"][0], place["pos"][0]
            kinds = [r[s] for r in body]
            out["elements"] = [_symbol(k) for k in kinds]
            out["kinds"] = kinds if kinds != out["elements"] else None
            out["positions"] = _vectors([r[p : p + 3] for r in body])
        except (ValueError, KeyError) as e:
            raise ValueError(f"line {begin}: {e}") from None
        for k, (a, w) in place.items():
            if k not in ("species", "pos"):
                out["site_attributes"][k] = [" ".join(r[a : a + w]) for r in body]
        yield out


def format_xyz(s: dict) -> str:
    sites = {k: v for k, v in (s.get("site_attributes") or {}).items() if v and len(v) == len(s["elements"]) and not any(" " in str(x) or x is None for x in v)}
    head = ['Lattice="' + " ".join(f"{x:.8f}" for r in s["cell"] for x in r) + '"'] if s.get("cell") else []
    head.append("Properties=species:S:1:pos:R:3" + "".join(f":{k}:S:1" for k in sites))
    head += [f'pbc="{" ".join("T" if p else "F" for p in s.get("pbc") or [bool(s.get("cell"))] * 3)}"'] + ([f'label="{s["label"]}"'] if s.get("label") else [])
    head += [f'{k}="{v}"' for k, v in (s.get("attributes") or {}).items() if v is not None and '"' not in str(v)]
    rows = [f"{e:<3} " + " ".join(f"{x:16.8f}" for x in p) + "".join(f" {v[i]}" for v in sites.values()) for i, (e, p) in enumerate(zip(s["elements"], cartesian(s)))]
    return "\n".join([str(len(rows)), " ".join(head), *rows])


def cartesian(s: dict) -> list[list[float]]:
    return (np.array(s["positions"]) @ np.array(s["cell"])).tolist() if s.get("cell") and s.get("is_cartesian") is False else s["positions"]


def scaled(s: dict) -> list[list[float]]:
    return s["positions"] if s.get("is_cartesian") is False else (np.array(s["positions"]) @ np.linalg.inv(np.array(s["cell"]))).tolist()


# XSF

_PERIODIC = {"CRYSTAL": 3, "SLAB": 2, "POLYMER": 1, "MOLECULE": 0, "ATOMS": 0}


def parse_xsf(text: str) -> Iterator[dict]:
    lines = [r.split() for r in text.splitlines() if r.strip() and not r.lstrip().startswith("#")]
    kind, cell, at = "CRYSTAL", None, 0
    while at < len(lines):
        word = lines[at][0].upper()
        at += 1
        if word in _PERIODIC and word != "ATOMS":
            kind = word
        elif word in ("PRIMVEC", "CONVVEC"):
            if word == "PRIMVEC":
                cell = _vectors(lines[at : at + 3])
            at += 3
        elif word in ("PRIMCOORD", "ATOMS"):
            if word == "PRIMCOORD":
                n = int(lines[at][0])
                at += 1
            else:
                kind, n = "ATOMS", 0
                while at + n < len(lines) and len(lines[at + n]) >= 4 and lines[at + n][0].upper() not in ("ATOMS", "PRIMVEC", "PRIMCOORD"):
                    n += 1
            body = lines[at : at + n]
            at += n
            if len(body) < n or any(len(r) < 4 for r in body):
                raise ValueError("a block of sites ends too early")
            wide = all(len(r) >= 7 for r in body)
            yield {
                "elements": [_symbol(r[0]) for r in body], "positions": _vectors([r[1:4] for r in body]), "cell": cell if _PERIODIC[kind] else None,
                "pbc": [i < _PERIODIC[kind] for i in range(3)], "site_attributes": {"forces": [" ".join(r[4:7]) for r in body]} if wide else {},
            }


def format_xsf(s: dict) -> str:
    periodic = sum(s.get("pbc") or [bool(s.get("cell"))] * 3) if s.get("cell") else 0
    rows = [f"{atomic_number(e):4d} " + " ".join(f"{x:14.8f}" for x in p) for e, p in zip(s["elements"], cartesian(s))]
    if not periodic:
        return "\n".join(["ATOMS", *rows])
    return "\n".join([["POLYMER", "SLAB", "CRYSTAL"][periodic - 1], "PRIMVEC", *[" ".join(f"{x:14.8f}" for x in v) for v in s["cell"]], "PRIMCOORD 1", f"{len(rows)} 1", *rows])


# CIF

_VALUE = re.compile(r"""'(?:[^']|'(?=\S))*'(?=\s|$)|"(?:[^"]|"(?=\S))*"(?=\s|$)|#.*|\S+""")


def cif_blocks(text: str) -> Iterator[tuple[str, dict[str, str], list[dict[str, list[str]]]]]:
    """(name, single values, loops) of each data block; tags in lower case, without their underscore."""
    tokens: list[str | tuple[str]] = []  # a tuple is a value that can't be a word of the syntax
    field: list[str] | None = None
    for line in text.splitlines():
        if line.startswith(";"):
            if field is None:
                field = [line[1:]]
            else:
                tokens.append(("\n".join(field).strip(),))
                field = None
        elif field is not None:
            field.append(line)
        else:
            for t in _VALUE.findall(line):
                if t.startswith("#"):
                    break
                quoted = len(t) > 1 and t[0] in "'\"" and t[-1] == t[0]
                tokens.append((t[1:-1],) if quoted else t)
    if field is not None:
        raise ValueError("a text field isn't closed")
    name, single, loops, at, open_ = "", {}, [], 0, False
    value = lambda t: t[0] if isinstance(t, tuple) else t
    word = lambda k: isinstance(tokens[k], str) and (tokens[k][0] == "_" or re.match(r"(?i)(data_|loop_|save_)", tokens[k]))
    while at < len(tokens):
        t = tokens[at]
        at += 1
        if isinstance(t, str) and t.lower().startswith("data_"):
            if open_:
                yield name, single, loops
            name, single, loops, open_ = t[5:], {}, [], True
        elif isinstance(t, str) and t.lower() == "loop_":
            heads = []
            while at < len(tokens) and isinstance(tokens[at], str) and tokens[at][0] == "_":
                heads.append(tokens[at][1:].lower())
                at += 1
            begin = at
            while at < len(tokens) and not word(at):
                at += 1
            rows = [value(x) for x in tokens[begin:at]]
            if not heads or len(rows) % len(heads):
                raise ValueError(f"block {name}: a loop of {len(heads)} columns has {len(rows)} values")
            loops.append({h: rows[i :: len(heads)] for i, h in enumerate(heads)})
        elif isinstance(t, str) and t[0] == "_":
            if at < len(tokens) and not word(at):
                single[t[1:].lower()] = value(tokens[at])
                at += 1
    if open_:
        yield name, single, loops


_TERM = re.compile(r"([+-]?)(?:(\d+\.?\d*|\.\d+)(?:/(\d+\.?\d*))?)?\*?([xyz])?")


def symmetry_operation(text: str) -> tuple[np.ndarray, np.ndarray]:
    """'x,y+1/2,-z' to a matrix and a shift."""
    rot, shift = np.zeros((3, 3)), np.zeros(3)
    parts = text.replace(" ", "").lower().split(",")
    if len(parts) != 3:
        raise ValueError(f"{text!r} is no symmetry operation")
    for row, part in enumerate(parts):
        for sign, num, den, axis in _TERM.findall(part):
            if not (num or axis):
                continue
            v = (-1.0 if sign == "-" else 1.0) * float(num or 1) / float(den or 1)
            if axis:
                rot[row, "xyz".index(axis)] += v
            else:
                shift[row] += v
    return rot, shift


def _number(text: str) -> float:
    return float(re.sub(r"\(\d+\)$", "", text))


def cell_vectors(a: float, b: float, c: float, alpha: float, beta: float, gamma: float) -> list[list[float]]:
    ca, cb, cg, sg = (math.cos(math.radians(alpha)), math.cos(math.radians(beta)), math.cos(math.radians(gamma)), math.sin(math.radians(gamma)))
    y = (ca - cb * cg) / sg
    return [[a, 0.0, 0.0], [b * cg, b * sg, 0.0], [c * cb, c * y, c * math.sqrt(max(1 - cb * cb - y * y, 0.0))]]


def expand(frac: np.ndarray, operations: list[tuple[np.ndarray, np.ndarray]], near: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(place of the site it comes from, fractions) of all images of sites that don't fall on an earlier one; sites on an earlier one are left out, too."""
    frac, origin = np.asarray(frac, float).reshape(-1, 3), []
    kept: list[np.ndarray] = []

    def add(x: np.ndarray, of: int) -> None:
        d = np.array(kept).reshape(-1, 3) - x
        if not len(kept) or (np.abs(d - np.rint(d)) ** 2).sum(1).min() > near**2:
            kept.append(x)
            origin.append(of)

    for k, x in enumerate(frac):
        add(x, k)
    for rot, shift in operations:
        for k, x in enumerate(frac):
            add(rot @ x + shift, k)
    return np.array(origin, int), np.array(kept)


SYMMETRY_TAGS = ("symmetry_equiv_pos_as_xyz", "space_group_symop_operation_xyz")


def parse_cif(text: str, check_formula: bool = True) -> Iterator[dict]:
    for name, single, loops in cif_blocks(text):
        sites = next((p for p in loops if "atom_site_fract_x" in p), None)
        if sites is None or "cell_length_a" not in single:
            continue
        try:
            cell = cell_vectors(*[_number(single[f"cell_{k}"]) for k in ("length_a", "length_b", "length_c", "angle_alpha", "angle_beta", "angle_gamma")])
            frac = np.array([[_number(v) for v in sites[f"atom_site_fract_{k}"]] for k in "xyz"]).T
            labels = sites.get("atom_site_label") or sites["atom_site_type_symbol"]
            elements = [_symbol(x) for x in sites.get("atom_site_type_symbol") or labels]
            ops = [symmetry_operation(x) for p in loops for tag in SYMMETRY_TAGS for x in p.get(tag, [])]
        except (ValueError, KeyError) as e:
            raise ValueError(f"block {name}: {e}") from None
        of, where = expand(frac, ops)
        elements, kinds = [elements[k] for k in of], [labels[k] for k in of]
        formula = parse_formula(single.get("chemical_formula_sum") or single.get("chemical_formula_structural"))
        if check_formula and formula:
            counts = {e: elements.count(e) for e in sorted(set(elements))}
            ratio = lambda f: dict(zip(sorted(f), reduce_quantities([float(f[k]) for k in sorted(f)])))
            if ratio(formula) != ratio(counts):
                raise ValueError(f"block {name}: the formula doesn't fit the sites")
        extra = {k.removeprefix("atom_site_"): [v[i] for i in of] for k, v in sites.items() if k not in ("atom_site_label", "atom_site_type_symbol") and not k.startswith("atom_site_fract_")}
        yield {"label": name or None, "elements": elements, "kinds": kinds if kinds != elements else None, "positions": where.tolist(), "is_cartesian": False, "cell": cell, "pbc": [True] * 3, "site_attributes": extra, "attributes": single}


def parameters(cell: list[list[float]]) -> list[float]:
    v = np.array(cell)
    a = np.linalg.norm(v, axis=1)
    cos = [v[(i + 1) % 3] @ v[(i + 2) % 3] / (a[(i + 1) % 3] * a[(i + 2) % 3]) for i in range(3)]
    return [*a.tolist(), *np.degrees(np.arccos(np.clip(cos, -1, 1))).tolist()]


def format_cif(s: dict) -> str:
    names = ("length_a", "length_b", "length_c", "angle_alpha", "angle_beta", "angle_gamma")
    head = [f"data_{re.sub(r'\s+', '_', s.get('label') or 'structure')}", "_symmetry_space_group_name_H-M 'P 1'", *[f"_cell_{n} {v:.6f}" for n, v in zip(names, parameters(s["cell"]))]]
    loop = ["loop_", "_symmetry_equiv_pos_as_xyz", "'x, y, z'", "loop_", "_atom_site_label", "_atom_site_type_symbol", "_atom_site_fract_x", "_atom_site_fract_y", "_atom_site_fract_z"]
    kinds = s.get("kinds") or [f"{e}{i + 1}" for i, e in enumerate(s["elements"])]
    return "\n".join([*head, *loop, *[f"{k} {e} " + " ".join(f"{x:.8f}" for x in p) for k, e, p in zip(kinds, s["elements"], scaled(s))], ""])


# zeo++: cssr, v1, cuc


def parse_zeo(text: str) -> Iterator[dict]:
    lines = [r for r in text.splitlines() if r.strip()]
    if lines and lines[0].lower().startswith("unit cell vectors"):
        cell = _vectors([r.split()[1:4] for r in lines[1:4]])
        body = [r.split() for r in lines[5 : 5 + int(lines[4])]]
        yield {"elements": [_symbol(r[0]) for r in body], "positions": _vectors([r[1:4] for r in body]), "cell": cell, "pbc": [True] * 3}
    elif len(lines) > 1 and lines[1].lower().startswith("unit_cell"):
        body = [r.split() for r in lines[2:]]
        yield {"label": lines[0].strip(), "elements": [_symbol(r[0]) for r in body], "positions": _vectors([r[1:4] for r in body]), "is_cartesian": False, "cell": cell_vectors(*map(float, lines[1].split()[1:7])), "pbc": [True] * 3}
    else:
        lengths, angles = [float(x) for x in lines[0].split()[-3:]], [float(x) for x in lines[1].split()[:3]]
        n, carts = int(lines[2].split()[0]), lines[2].split()[1] != "0"
        body = [r.split() for r in lines[4 : 4 + n]]
        if len(body) < n:
            raise ValueError("the list of sites ends too early")
        yield {"elements": [_symbol(r[1]) for r in body], "positions": _vectors([r[2:5] for r in body]), "is_cartesian": carts, "cell": cell_vectors(*lengths, *angles), "pbc": [True] * 3}


def format_cssr(s: dict) -> str:
    p = parameters(s["cell"])
    head = [" " * 38 + " ".join(f"{x:7.3f}" for x in p[:3]), " " * 21 + " ".join(f"{x:7.3f}" for x in p[3:]) + "    SPGR =  1 P 1         OPT = 1", f"{len(s['elements']):4d} 0", f"0 {s.get('label') or 'structure'}"]
    return "\n".join(head + [f"{i + 1:4d} {e:<4} " + " ".join(f"{x:10.5f}" for x in q) + "  0 0 0 0 0 0 0 0 0.000" for i, (e, q) in enumerate(zip(s["elements"], scaled(s)))])


def format_v1(s: dict) -> str:
    return "\n".join(["Unit cell vectors:", *[f"v{k}= " + " ".join(f"{x:.8f}" for x in v) for k, v in zip("abc", s["cell"])], str(len(s["elements"])), *[f"{e} " + " ".join(f"{x:.8f}" for x in p) for e, p in zip(s["elements"], cartesian(s))]])


def format_cuc(s: dict) -> str:
    return "\n".join([s.get("label") or "structure", "Unit_cell: " + " ".join(f"{x:.8f}" for x in parameters(s["cell"])), *[f"{e} " + " ".join(f"{x:.8f}" for x in p) for e, p in zip(s["elements"], scaled(s))]])


# geometry.in


def parse_geometry_in(text: str) -> Iterator[dict]:
    cell, sites = [], []
    for line in text.splitlines():
        r = line.split("#")[0].split()
        if r and r[0] == "lattice_vector":
            cell += _vectors([r[1:4]])
        elif r and r[0] in ("atom", "atom_frac"):
            if len(r) < 5:
                raise ValueError("a site has three coordinates and a species")
            sites.append(r)
    modes = {r[0] for r in sites}
    if len(modes) > 1:
        raise ValueError("sites are given as atom and as atom_frac")
    if len(cell) not in (0, 3):
        raise ValueError("there are three lattice vectors or none")
    elements = [_symbol(r[4]) for r in sites]
    kinds = [r[4] for r in sites]
    yield {"elements": elements, "kinds": kinds if kinds != elements else None, "positions": _vectors([r[1:4] for r in sites]), "is_cartesian": modes != {"atom_frac"}, "cell": cell or None, "pbc": [bool(cell)] * 3}


def format_geometry_in(s: dict, fractions: bool = False) -> str:
    fractions = fractions and bool(s.get("cell"))
    cell = ["lattice_vector " + " ".join(f"{x:.8f}" for x in v) for v in s.get("cell") or []]
    return "\n".join(cell + [f"{'atom_frac' if fractions else 'atom'} " + " ".join(f"{x:.8f}" for x in p) + f" {k or e}" for e, k, p in zip(s["elements"], s.get("kinds") or s["elements"], scaled(s) if fractions else cartesian(s))])


# plane-wave input with namelists and cards


def parse_qe_input(text: str) -> Iterator[dict]:
    clean = "\n".join(re.split(r"[!#]", r)[0] for r in text.splitlines())
    keys = {k.lower(): v.strip().strip("'\"") for k, v in re.findall(r"([\w()]+)\s*=\s*([^,\n/]+)", clean)}
    lines = [r.split() for r in clean.splitlines() if r.strip()]
    card = {r[0].upper(): i for i, r in enumerate(lines)}
    num = lambda k: float(keys[k].lower().replace("d", "e"))
    ibrav, n = int(keys.get("ibrav", 0)), int(keys["nat"])
    alat = num("celldm(1)") * BOHR if "celldm(1)" in keys else num("a") if "a" in keys else None
    unit = lambda at: re.sub(r"[(){}]", "", " ".join(lines[at][1:])).lower()
    if ibrav == 0:
        at = card["CELL_PARAMETERS"]
        factor = {"bohr": BOHR, "angstrom": 1.0}.get(unit(at), alat)
        cell = _vectors(lines[at + 1 : at + 4], factor or 1.0)
    elif ibrav == 8:
        b = num("celldm(2)") * alat if "celldm(2)" in keys else num("b")
        c = num("celldm(3)") * alat if "celldm(3)" in keys else num("c")
        cell = [[alat, 0.0, 0.0], [0.0, b, 0.0], [0.0, 0.0, c]]
    else:
        raise ValueError(f"ibrav = {ibrav} isn't known")
    at = card["ATOMIC_POSITIONS"]
    body, kind = lines[at + 1 : at + 1 + n], unit(at)
    if len(body) < n:
        raise ValueError("the list of sites ends too early")
    factor = {"bohr": BOHR, "angstrom": 1.0, "crystal": 1.0}.get(kind, alat or 1.0)
    labels = [r[0] for r in body]
    elements = [_symbol(x) for x in labels]
    yield {"elements": elements, "kinds": labels if labels != elements else None, "positions": _vectors([r[1:4] for r in body], factor), "is_cartesian": kind != "crystal", "cell": cell, "pbc": [True] * 3}


# restart files with nested sections


def parse_cp2k_restart(text: str) -> Iterator[dict]:
    last = lambda name: (re.findall(rf"(?ms)^\s*&{name}\b[^\n]*\n(.*?)^\s*&END {name}\b", text) or [""])[-1]
    lines = [r.split() for r in last("CELL").splitlines() if r.strip()]
    get = {r[0].upper(): r[1:] for r in lines}
    cell = _vectors([get[k] for k in "ABC"]) if all(k in get for k in "ABC") else None
    times = [int(x) for x in get.get("MULTIPLE_UNIT_CELL", ["1", "1", "1"])]
    if cell:
        cell = [[x * m for x in v] for v, m in zip(cell, times)]
    periodic = get.get("PERIODIC", ["XYZ"])[0].upper()
    known = {k: e for k, e in re.findall(r"(?ms)^\s*&KIND (\S+).*?^\s*ELEMENT\s+(\S+)", text)}
    body = [r.split() for r in last("COORD").splitlines() if len(r.split()) >= 4]

    def real(x: str) -> float:
        try:
            return float(x)
        except ValueError:
            return 0.0

    unit = [r for r in body if r[0].upper() in ("UNIT", "SCALED")]
    body = [r for r in body if r not in unit]
    elements = [_symbol(known.get(r[0], r[0])) for r in body]
    kinds = [r[0] for r in body]
    yield {"elements": elements, "kinds": kinds if kinds != elements else None, "positions": [[real(x) for x in r[1:4]] for r in body], "cell": cell, "pbc": [a in periodic and periodic != "NONE" for a in "XYZ"]}


# volumetric data


def parse_cube(text: str) -> Iterator[dict]:
    lines = text.splitlines()
    n, *origin = lines[2].split()[:4]
    count = abs(int(n))
    axes = [lines[3 + i].split() for i in range(3)]
    shape = [abs(int(a[0])) for a in axes]
    cell = [[float(x) * k * BOHR for x in a[1:4]] for a, k in zip(axes, shape)]
    body = [r.split() for r in lines[6 : 6 + count]]
    if len(body) < count:
        raise ValueError("the list of sites ends too early")
    shift = np.array(origin, float)
    positions = ((np.array([[float(x) for x in r[2:5]] for r in body]) - shift) * BOHR).tolist()
    values = " ".join(lines[6 + count + (int(n) < 0) :]).split()
    yield {
        "elements": [SYMBOLS[int(r[0]) - 1] for r in body], "positions": positions, "cell": cell, "pbc": [True] * 3, "site_attributes": {"charge": [r[1] for r in body]},
        "attributes": {"title": lines[0].strip(), "comment": lines[1].strip(), "shape": " ".join(map(str, shape)), "n_values": str(len(values))},
    }


def cube_values(text: str) -> Iterator[tuple[int, int, int, float]]:
    """(ix, iy, iz, value) of a cube file's grid."""
    lines = text.splitlines()
    n = int(lines[2].split()[0])
    shape = [abs(int(lines[3 + i].split()[0])) for i in range(3)]
    values = " ".join(lines[6 + abs(n) + (n < 0) :]).split()
    if len(values) != math.prod(shape):
        raise ValueError(f"a grid of {math.prod(shape)} points has {len(values)} values")
    for k, v in enumerate(values):
        yield k // (shape[1] * shape[2]), k // shape[2] % shape[1], k % shape[2], float(v)


def format_cube(s: dict, shape: tuple[int, int, int], values: list[float]) -> str:
    cell = np.array(s["cell"]) / BOHR
    rows = [f"{n:5d} " + " ".join(f"{x:12.6f}" for x in v / n) for n, v in zip(shape, cell)]
    sites = [f"{atomic_number(e):5d} {float(atomic_number(e)):12.6f} " + " ".join(f"{x / BOHR:12.6f}" for x in p) for e, p in zip(s["elements"], cartesian(s))]
    body = [" ".join(f"{v:13.5E}" for v in values[i : i + 6]) for i in range(0, len(values), 6)]
    return "\n".join([s.get("label") or "structure", "values on a grid", f"{len(sites):5d} " + " ".join(f"{0.0:12.6f}" for _ in range(3)), *rows, *sites, *body])


#: Format name, pattern of file names, parser.
PARSERS: dict[str, tuple[str, Callable[[str], Iterator[dict]]]] = {
    "xyz": (r"\.(ext)?xyz$", parse_xyz), "xsf": (r"\.a?xsf$", parse_xsf), "cif": (r"\.cif$", parse_cif), "zeo": (r"\.(cssr|v1|cuc)$", parse_zeo),
    "geometry_in": (r"geometry\.in(\.next_step)?$", parse_geometry_in), "qe_input": (r"\.(pwi|in)$", parse_qe_input), "cp2k_restart": (r"\.restart$", parse_cp2k_restart), "cube": (r"\.cube$", parse_cube),
}
WRITERS: dict[str, Callable[[dict], str]] = {"xyz": format_xyz, "xsf": format_xsf, "cif": format_cif, "cssr": format_cssr, "v1": format_v1, "cuc": format_cuc, "geometry_in": format_geometry_in}


def parser_for(name: str, fmt: str | None = None) -> Callable[[str], Iterator[dict]]:
    """The parser of a format, or else of the first format whose pattern a file name fits."""
    if fmt:
        return PARSERS[fmt][1]
    for pattern, parse in PARSERS.values():
        if re.search(pattern, name, re.I):
            return parse
    raise ValueError(f"no format is known for {name}")
