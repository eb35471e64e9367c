"""More text columns: spacing repairs, joined words, formulas, payloads, header fields of pictures, suffix edits."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lessonloom.functions.text import nfkc


def spaced_sentences(c: Column) -> Column:
    """A blank behind a stop that a capital follows directly."""
    return F.regexp_replace(c, r"(?<=[\p{Ll}\d][.!?])(?=\p{Lu})", " ")


def takeaway_problem(c: Column) -> Column:
    """Too long, cut off at a sign, or with an unpaired quote; null if none."""
    quotes = F.length(c) - F.length(F.replace(c, F.lit('"')))
    return F.when(F.length(c) > 500, "TOO_LONG").when(F.rtrim(c).rlike("[,;:]$"), "CUT_OFF").when(quotes % 2 == 1, "ODD_QUOTES")


@F.pandas_udf(T.StringType())
def _casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x.casefold())


def folded(c: Column) -> Column:
    """Full case folding. Only letters that fold to others than their small ones leave the JVM."""
    return F.coalesce(_casefold(F.when(c.rlike(r"[^\x{0}-\x{7f}\x{c0}-\x{de}\x{e0}-\x{148}\x{14a}-\x{17e}\x{1a0}-\x{1b0}\x{1ea0}-\x{1ef9}\x{300}-\x{344}\p{P}\s]"), c)), F.lower(c))


def heading_key(c: Column) -> Column:
    """Headings are the same if these are: compatibility form, folded case, words only."""
    return F.trim(F.regexp_replace(folded(nfkc(c)), r"[^\p{L}\p{N}]+", " "))


def plain_learner_text(c: Column) -> Column:
    """Without addresses, file names and page labels; spacing closed up."""
    c = F.regexp_replace(nfkc(c), r"(?i)(?:https?://|www\.)\S+", "")
    c = F.regexp_replace(c, r"(?i)[^\s/\\<>:\"|?*]{1,80}\.(?:pdf|pptx?|docx?)\b", "")
    c = F.regexp_replace(c, r"(?iU)\s*\(?\b(?:trang|slide|page)\s*\d+(?:\s*[-–]\s*\d+)?\)?", "")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def both(c: Column, a: str, b: str) -> Column:
    """Whether two patterns stand in one text, as with commands of two shells."""
    return c.rlike(a) & c.rlike(b)


def joined_words(c: Column, left: tuple[str, ...], right: tuple[str, ...]) -> Column:
    """Tokens that are two known words run together."""
    tokens = F.filter(F.regexp_extract_all(c, F.lit(r"\p{L}{4,}"), F.lit(0)), lambda t: t.rlike(r"[^\x00-\x7f]"))
    pattern = "(?iU)^(?:" + "|".join(map(re.escape, left)) + ")(?:" + "|".join(map(re.escape, right)) + ")"
    return F.filter(tokens, lambda t: t.rlike(pattern))


def without_supplement(c: Column, supplement: Column) -> Column:
    """A text without a supplement that was added at its end, its start or inside."""
    return F.when(c.endswith(supplement), F.rtrim(F.left(c, F.length(c) - F.length(supplement)))).when(c.startswith(supplement), F.ltrim(F.substr(c, F.length(supplement) + 1))).otherwise(F.replace(c, supplement, F.lit("")))


def json_payload(c: Column) -> Column:
    """The outermost braces of a text with words or fences around."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def schema_problems(c: Column, required: dict[str, str]) -> Column:
    """Names of required fields that a JSON text lacks or that hold another type."""
    v = F.try_parse_json(c)
    miss = [F.when(F.try_variant_get(v, f"$.{n}", t).isNull(), F.lit(n)) for n, t in required.items()]
    return F.when(v.isNull(), F.array(F.lit("$"))).otherwise(F.array_compact(F.array(*miss)))


def png_size(content: Column) -> Column:
    """(width, height) from the header of a picture; null if it isn't one."""
    number = lambda k: F.conv(F.hex(F.substring(content, k, 4)), 16, 10).cast("int")
    return F.when(F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A", F.struct(number(17).alias("width"), number(21).alias("height")))


#: Signs that commands of formulas show (fixed values).
SIGNS = {
    "cdot": "·", "times": "×", "div": "÷", "to": "→", "rightarrow": "→", "Rightarrow": "⇒", "leftarrow": "←", "leftrightarrow": "↔", "mapsto": "↦",
    "sum": "∑", "prod": "∏", "int": "∫", "oint": "∮", "partial": "∂", "nabla": "∇", "infty": "∞", "in": "∈", "notin": "∉", "subset": "⊂", "subseteq": "⊆", "supset": "⊃", "supseteq": "⊇", "cup": "∪", "cap": "∩",
    "le": "≤", "leq": "≤", "ge": "≥", "geq": "≥", "ne": "≠", "neq": "≠", "approx": "≈", "sim": "∼", "simeq": "≃", "equiv": "≡", "propto": "∝", "pm": "±", "mp": "∓",
    "ldots": "…", "cdots": "⋯", "vdots": "⋮", "ddots": "⋱", "ell": "ℓ", "top": "ᵀ", "perp": "⊥", "mid": "∣", "lVert": "‖", "rVert": "‖", "langle": "⟨", "rangle": "⟩", "lfloor": "⌊", "rfloor": "⌋", "lceil": "⌈", "rceil": "⌉",
    "varepsilon": "ε", "vartheta": "ϑ", "varphi": "ϕ", "quad": " ", "qquad": " ", "enspace": " ", "left": "", "right": "", "big": "", "Big": "", "bigl": "", "bigr": "", "Bigl": "", "Bigr": "",
}
#: Greek letters that are commands (fixed values).
GREEK = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau upsilon phi chi psi omega Gamma Delta Theta Lambda Xi Pi Sigma Phi Psi Omega"
SIGNS |= {g: unicodedata.lookup(f"GREEK {'SMALL' if g.islower() else 'CAPITAL'} LETTER {g.upper().replace('LAMBDA', 'LAMDA')}") for g in GREEK.split()}
#: Marks that commands set over each letter (fixed values).
OVER = {"hat": "\u0302", "bar": "\u0305", "overline": "\u0305", "tilde": "\u0303", "vec": "\u20d7"}
#: Commands that show their argument as it is (fixed values).
STYLES = frozenset("text texttt mathrm mathbf mathbb mathcal operatorname".split())
#: A text that holds one of these is a formula (fixed values).
_SIGNAL = re.compile(
    r"\\(?:frac|sqrt|sum|prod|int|partial|nabla|hat|bar|vec|theta|alpha|beta|gamma|delta|epsilon|eta|lambda|mu|sigma|phi|psi|omega|mathrm|mathbf|mathbb|mathcal|operatorname|log|exp|left|right|times|cdot|rightarrow|to|leq|geq|neq|approx)\b|[A-Za-z][_^](?:\{|[A-Za-z0-9])|->"
)
_OPERATORS = "=+-×·*/≈<>≤≥≠"
_INDEXED = re.compile(r"\b[A-Za-z][0-9ivjktn]+\b")
_TOKEN = re.compile(r"\\[^\W\d_]+|\\.|\\$|[{}_^$&\[\]]|\s+|[^\\{}_^$&\[\]\s]", re.S)


def _scripts(kind: str, minus: str) -> dict[int, str]:
    """Raised or lowered forms of ASCII signs, by the decompositions that Unicode gives."""
    out = {ord("-"): minus}
    for k in range(0x80, 0x3000):
        d = unicodedata.decomposition(chr(k))
        if d.startswith(f"<{kind}> ") and len(d.split()) == 2 and int(d.split()[1], 16) < 128:
            out[int(d.split()[1], 16)] = chr(k)
    return out


_UP, _DOWN = _scripts("super", "⁻"), _scripts("sub", "₋")


def _tree(tokens: list[str]) -> list:
    """Tokens with what stands in braces as lists; braces without a partner are dropped."""
    levels: list[list] = [[]]
    for t in tokens:
        if t == "{":
            levels.append([])
        elif t == "}":
            if len(levels) > 1:
                levels[-2].append(levels.pop())
        else:
            levels[-1].append(t)
    while len(levels) > 1:
        levels[-2].append(levels.pop())
    return levels[0]


def _flat(node) -> str:
    return node if isinstance(node, str) else "{" + "".join(map(_flat, node)) + "}"


def _shown(nodes: list) -> str:
    """A tree as plain signs. Nodes wait on a stack, so a command takes its arguments from its top."""
    rest = nodes[::-1]

    def space() -> None:
        while rest and isinstance(rest[-1], str) and rest[-1].isspace():
            rest.pop()

    def argument() -> str:
        space()
        if not rest:
            return ""
        node = rest.pop()
        return _shown(node) if isinstance(node, list) else command(node[1:]) if node[0] == "\\" else node

    def optional() -> str:
        space()
        if not rest or rest[-1] != "[":
            return ""
        rest.pop()
        inside = []
        while rest and rest[-1] != "]":
            inside.append(_flat(rest.pop()))
        if rest:
            rest.pop()
        return "".join(inside)

    def command(name: str) -> str:
        if not name[:1].isalpha():
            return {"": "", "\\": " ; ", ",": " ", ";": " ", ":": " ", "!": " "}.get(name, name)
        if name in SIGNS:
            return SIGNS[name]
        if name in STYLES:
            return argument()
        if name in OVER:
            return "".join(c if c.isspace() else c + OVER[name] for c in argument())
        if name in ("frac", "dfrac", "tfrac"):
            return f"({argument().strip()}) ÷ ({argument().strip()})"
        if name == "binom":
            return f"C({argument().strip()}, {argument().strip()})"
        if name == "sqrt":
            degree, inside = optional(), argument().strip()
            return f"{'' if degree.strip() in ('', '2') else degree.translate(_UP)}√({inside})"
        if name == "xrightarrow":
            label = argument().strip()
            return f"—{label}→" if label else "→"
        if name in ("begin", "end"):
            space()
            if rest and isinstance(rest[-1], list):
                rest.pop()
            return ""
        return name

    out = []
    while rest:
        node = rest.pop()
        if isinstance(node, list):
            out.append(_shown(node))
        elif node in ("_", "^"):
            out.append(argument().translate(_DOWN if node == "_" else _UP))
        elif node[0] == "\\":
            out.append(command(node[1:]))
        elif node != "$":
            out.append("  " if node == "&" else node)
    return "".join(out)


def formula_text(s: str | None) -> str | None:
    """A formula in plain signs: fractions as (a) ÷ (b), commands as signs, scripts raised and lowered. Other texts stay as they are."""
    if s is None or not s.strip():
        return s
    bare = s.strip()
    if not _SIGNAL.search(s) and not _INDEXED.fullmatch(bare) and not (_INDEXED.search(s) and any(c in _OPERATORS for c in s)):
        return s
    if len(bare) >= 2 and bare[0] == bare[-1] == "$":
        bare = bare[1:-1]
    for a, b in (("\\(", "\\)"), ("\\[", "\\]")):
        if bare.startswith(a) and bare.endswith(b) and len(bare) >= 4:
            bare = bare[2:-2]
    try:
        shown = _shown(_tree(_TOKEN.findall(bare)))
    except RecursionError:  # nested by the hundreds: no formula
        return s

    def index(m: re.Match) -> str:
        near = shown[: m.start()].rstrip()[-1:] + shown[m.end() :].lstrip()[:1]
        alone = shown.strip() == m[0]
        return m[0][0] + m[0][1:].translate(_DOWN) if alone or any(c in _OPERATORS for c in near) else m[0]

    shown = _INDEXED.sub(index, shown).replace("->", "→")
    for pattern, by in ((r"\s*([=+×·÷→←≤≥≠≈∝∈∉∪∩])\s*", r" \1 "), (r"\s*,\s*", ", "), (r"\(\s+", "("), (r"\s+\)", ")"), (r"\s+", " ")):
        shown = re.sub(pattern, by, shown)
    return shown.strip()


def first_fraction(s: str | None) -> dict[str, str] | None:
    """The first fraction of a formula and what stands around it, groups of any depth kept as written; null if there is none or a brace is open."""
    if s is None:
        return None
    bare = s.strip()
    if len(bare) >= 2 and bare[0] == bare[-1] == "$":
        bare = bare[1:-1]
    for a, b in (("\\(", "\\)"), ("\\[", "\\]")):
        if bare.startswith(a) and bare.endswith(b) and len(bare) >= 4:
            bare = bare[2:-2]
    partner, open_at = {}, []
    for m in re.finditer(r"[{}]", bare):
        if m[0] == "{":
            open_at.append(m.start())
        elif open_at:
            partner[open_at.pop()] = m.start()
    command = re.search(r"\\[dt]?frac", bare)
    ends = []
    at = command.end() if command else 0
    for _ in range(2 if command else 0):
        at += len(bare[at:]) - len(bare[at:].lstrip())
        if at not in partner:
            return None
        ends.append((at + 1, partner[at]))
        at = partner[at] + 1
    if not ends:
        return None
    return {"prefix": bare[: command.start()], "numerator": bare[slice(*ends[0])], "denominator": bare[slice(*ends[1])], "suffix": bare[at:]}


def fraction(c: Column) -> Column:
    """(prefix, numerator, denominator, suffix) of the first fraction of a formula."""
    return F.udf(first_fraction, T.StructType([T.StructField(n, T.StringType()) for n in ("prefix", "numerator", "denominator", "suffix")]), useArrow=True)(c)


def formula(c: Column) -> Column:
    return F.udf(formula_text, T.StringType(), useArrow=True)(c)


def option_key(c: Column, keep_case: Column) -> Column:
    """Options are the same if these are: compatibility form, single spaces, and folded case unless case tells them apart."""
    plain = F.trim(F.regexp_replace(nfkc(c), r"\s+", " "))
    return F.when(keep_case, plain).otherwise(folded(plain))
