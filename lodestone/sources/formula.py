"""Office formulas as LaTeX."""

from __future__ import annotations

from xml.etree.ElementTree import Element

MATH = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
# Signs of operators over a range, and of accents.
_RANGES = {"∑": "\\sum", "∏": "\\prod", "∫": "\\int", "∬": "\\iint", "∮": "\\oint", "⋃": "\\bigcup", "⋂": "\\bigcap"}
_ACCENTS = {"̂": "\\hat", "̃": "\\tilde", "̅": "\\bar", "̄": "\\bar", "⃗": "\\vec", "̇": "\\dot"}


def _part(e: Element, name: str) -> str:
    found = e.find(MATH + name)
    return latex(found) if found is not None else ""


def _value(e: Element, properties: str, name: str, default: str) -> str:
    found = e.find(f"{MATH}{properties}/{MATH}{name}")
    return default if found is None else found.get(f"{MATH}val", default)


def _rows(e: Element, row: str) -> str:
    return " \\\\ ".join(" & ".join(latex(c) for c in r.findall(f"{MATH}e")) if row == "mr" else latex(r) for r in e.findall(MATH + row))


def _scripts(e: Element) -> str:
    low, high = _part(e, "sub"), _part(e, "sup")
    return (f"_{{{low}}}" if low else "") + (f"^{{{high}}}" if high else "")


_FORMS = {
    "f": lambda e: f"\\frac{{{_part(e, 'num')}}}{{{_part(e, 'den')}}}",
    "rad": lambda e: "\\sqrt" + (f"[{_part(e, 'deg')}]" if _part(e, "deg") else "") + f"{{{_part(e, 'e')}}}",
    "sSup": lambda e: f"{{{_part(e, 'e')}}}{_scripts(e)}",
    "sSub": lambda e: f"{{{_part(e, 'e')}}}{_scripts(e)}",
    "sSubSup": lambda e: f"{{{_part(e, 'e')}}}{_scripts(e)}",
    "nary": lambda e: _RANGES.get(sign := _value(e, "naryPr", "chr", "∫"), sign) + _scripts(e) + f" {_part(e, 'e')}",
    "d": lambda e: f"\\left{_value(e, 'dPr', 'begChr', '(') or '.'}" + ", ".join(latex(x) for x in e.findall(f"{MATH}e")) + f"\\right{_value(e, 'dPr', 'endChr', ')') or '.'}",
    "func": lambda e: f"\\{_part(e, 'fName')}{{{_part(e, 'e')}}}",
    "acc": lambda e: f"{_ACCENTS.get(_value(e, 'accPr', 'chr', chr(0x302)), chr(92) + 'hat')}{{{_part(e, 'e')}}}",
    "bar": lambda e: f"\\overline{{{_part(e, 'e')}}}",
    "limLow": lambda e: f"{_part(e, 'e')}_{{{_part(e, 'lim')}}}",
    "limUpp": lambda e: f"{_part(e, 'e')}^{{{_part(e, 'lim')}}}",
    "m": lambda e: f"\\begin{{matrix}}{_rows(e, 'mr')}\\end{{matrix}}",
    "eqArr": lambda e: f"\\begin{{aligned}}{_rows(e, 'e')}\\end{{aligned}}",
    "t": lambda e: e.text or "",
}


def latex(e: Element) -> str:
    """The formula below an element; parts without a form of their own are read through."""
    return "".join(_FORMS.get(c.tag.removeprefix(MATH), latex)(c) for c in e if not c.tag.endswith("Pr"))
