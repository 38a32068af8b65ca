"""Mathematical answers as column expressions: extraction, normalisation, and equality of strings and numbers.

Symbolic simplification needs a computer-algebra library and isn't part of this.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import last_boxed, strip, unboxed


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then of a value that is computed once, however often then uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _drop(c: Column, *parts: str) -> Column:
    for p in parts:
        c = F.replace(c, F.lit(p), F.lit(""))
    return c


def strip_latex(c: Column) -> Column:
    """The normal form of a TeX answer: without spacing, units, degrees, dollars and percents; fractions and roots in braces; a short
    left side of an equation dropped; whole-number quotients as fractions."""
    c = F.replace(_drop(c, "\n", "\\!"), F.lit("\\\\"), F.lit("\\"))
    c = F.replace(F.replace(c, F.lit("tfrac"), F.lit("frac")), F.lit("dfrac"), F.lit("frac"))
    c = _drop(c, "\\left", "\\right", "^{\\circ}", "^\\circ", "\\$")
    c = F.regexp_replace(c, r"(?s)^(.*?)\\text\{ .*$", "$1")
    c = _drop(c, "\\%")
    c = F.replace(F.replace(c, F.lit(" ."), F.lit(" 0.")), F.lit("{."), F.lit("{0."))
    c = F.regexp_replace(c, r"^\.", "0.")
    c = F.regexp_replace(c, r"(?s)^[^=]{0,2}=([^=]*)$", "$1")
    c = F.regexp_replace(c, r"\\sqrt([^{])", r"\\sqrt{$1}")
    c = _drop(c, " ")
    c = F.regexp_replace(F.regexp_replace(c, r"\\frac([^{\\])([^{\\])", r"\\frac{$1}{$2}"), r"\\frac([^{\\])\{", r"\\frac{$1}{")
    c = F.regexp_replace(c, r"^0\.5$", r"\\frac{1}{2}")
    return F.regexp_replace(c, r"^(0|-?[1-9][0-9]*)/(0|-?[1-9][0-9]*)$", r"\\frac{$1}{$2}")


def equivalent(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(strip_latex(a) == strip_latex(b))


def boxed_answer(response: Column) -> Column:
    r"""What is in the last box; behind a last "\boxed " up to the next dollar."""
    bare = F.regexp_extract(response, r"(?s).*\\boxed ([^$]*)", 1)
    return F.when(response.contains("\\boxed "), bare).otherwise(unboxed(last_boxed(response)))


def boxed_score(response: Column, gold: Column) -> Column:
    """1 if the last box holds an equivalent of the gold answer, else 0."""
    found = boxed_answer(response)
    return F.when(found.isNotNull() & equivalent(found, gold), 1.0).otherwise(0.0)


def strict_box(response: Column, gold: Column, tail: int = 100) -> Column:
    """struct(score, pred): 1 if the box at the text's end is the gold answer as it stands, else -1."""
    found = unboxed(last_boxed(F.right(response, F.lit(tail))))
    return F.struct(F.when(F.coalesce(found == gold, F.lit(False)), 1).otherwise(-1).alias("score"), found.alias("pred"))


# --- numbers and tuples -------------------------------------------------------------------------------------------

_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
#: Units that are dropped with their plural and power.
UNITS = ["degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "day", "week", "month", "year", "foot", "feet", "inch", "yard", "liter"]


def number(c: Column) -> Column:
    """The number that a text is (with commas), or null."""
    c = F.replace(F.replace(F.trim(c), F.lit("{,}"), F.lit("")), F.lit(","), F.lit(""))
    return F.when(c.rlike(_NUMBER), c.try_cast("double"))


def near(a: Column, b: Column, tolerance: float = 1e-4) -> Column:
    return F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b))


def same_number(a: Column, b: Column, percent: bool = True) -> Column:
    """Whether both are numbers and near each other; percent: also as a hundredth or a hundredfold. Null if one isn't a number."""
    x, y = number(a), number(b)
    out = near(y, x)
    return out | near(y / 100, x) | near(y * 100, x) if percent else out


def without_thousands(c: Column) -> Column:
    """Without commas between digits that part groups of three."""
    return F.regexp_replace(c, r"(?<=[0-9]),(?=[0-9]{3}(?:[^0-9]|$))", "")


#: Words for powers of ten, and the rewrites of an answer before and behind the words and units.
POWERS = {"million": 6, "billion": 9, "trillion": 12}
BEFORE = [(r"^\\text\{(.+?)\}$", "$1"), (r"\\?[$%]", ""), (r" (?:or|and)(?= )", " ,")]
BEHIND = [(r"\^ *\\circ", ""), (r"^\{(.*)\}$", "$1"), (r",\\! *", ""), (r"- *", "-"), (r"([0-9]) +([0-9])", "$1+$2")]


def plain_answer(c: Column) -> Column:
    """Lower case, without text boxes, percents, dollars, units and braces; millions as powers; mixed numbers as sums."""
    words = [(word, f"*10^{power}") for word, power in POWERS.items()]
    units = [(unit + r"(?:es)?s? *(?:\^[0-9]+)?", "") for unit in UNITS]
    c = F.lower(reduce(lambda x, rewrite: F.regexp_replace(x, *rewrite), [*BEFORE, *words, *units, *BEHIND], c))

    def as_whole(x: Column) -> Column:
        n = number(without_thousands(F.trim(x)))
        return F.when((n == F.round(n)) & (F.abs(n) < 1e15), n.cast("long").cast("string")).otherwise(x)

    return _let(c, as_whole)


def parts(c: Column) -> Column:
    """The elements of a tuple or interval, or the whole."""
    c = without_thousands(c)
    inner = F.regexp_extract(c, r"^[(\[]([^()\[\]]+)[)\]]$", 1)
    return F.when(inner != "", F.transform(F.split(inner, ","), F.trim)).otherwise(F.array(c))


def safe_to_evaluate(c: Column) -> Column:
    """At most two unknown letters and no nested powers."""
    letters = F.array_distinct(F.regexp_extract_all(_drop(c, "sqrt", "frac"), F.lit(r"(\p{L})"), F.lit(1)))
    return (F.size(letters) <= 2) & ~c.contains("^{") & ~c.contains("^(") & ~c.rlike(r"\^[0-9]+\^|\^[0-9][0-9]+")


def grade(given: Column, gold: Column) -> Column:
    """Whether an answer is the gold one: by normal forms, then element by element of tuples with the same brackets, where whole numbers
    equal only whole numbers, fractions are compared as they stand, and other numbers may be near."""
    whole = lambda x: F.coalesce(F.abs(number(x) - F.round(number(x))) <= 1e-7, F.lit(False))
    fraction = lambda x: x.rlike(r"^-?[0-9]+.?/0*[1-9][0-9]*.?$")
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, r"^\$(?=[0-9])", ""), r"\\?%$", "")

    def one(x: Column, y: Column) -> Column:
        return F.when(fraction(x) & fraction(y), x == y).when(whole(x) != whole(y), F.lit(False)).otherwise((x == y) | F.coalesce(same_number(x, y, percent=False), F.lit(False)))

    def alike(p: Column) -> Column:
        a, b, xs, ys = p["a"], p["b"], p["xs"], p["ys"]
        edges = (F.size(ys) <= 1) | ((F.left(a, F.lit(1)) == F.left(b, F.lit(1))) & (F.right(a, F.lit(1)) == F.right(b, F.lit(1))))
        element = (F.size(xs) == F.size(ys)) & edges & F.forall(F.zip_with(xs, ys, one), lambda x: F.coalesce(x, F.lit(False)))
        return (a == b) | ((a != "") & element)

    pair = _let(F.struct(plain_answer(given).alias("a"), plain_answer(gold).alias("b")), lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), parts(p["a"]).alias("xs"), parts(p["b"]).alias("ys")))
    number_ok = F.coalesce(same_number(bare(given), bare(gold)), F.lit(False))
    return F.coalesce(given.isNotNull() & (equivalent(strip(given), strip(gold)) | _let(pair, alike) | number_ok), F.lit(False))


#: What stands before an answer and what stands behind it, any of which marks one, and what leads up to it in a sentence.
MARKS_BEFORE = ("answer:", "answer is", "answers are")
MARKS_BEHIND = ("is answer", "is the answer", "are answers", "are the answers")
LEADS = ("be ", "is ", "are ", "=", ": ", "get ", "be\n", "is\n", "are\n", ":\n", "get\n")


def _from_last(marks: tuple[str, ...], keep: int) -> Callable[[Column], Column]:
    """Cuts a text at the last place of each mark in turn: keep 1 is what is before it, 2 what is behind it."""
    return lambda c: reduce(lambda x, m: strip(F.regexp_replace(x, f"(?is)^(.*){m}(.*)$", f"${keep}")), marks, c)


def stated_answer(response: Column) -> Column:
    """struct(found, answer): what a response states behind its last marker, box or equals sign; found if it has a digit."""
    marked = response.rlike("(?i)" + "|".join(MARKS_BEFORE + MARKS_BEHIND)) | response.rlike(r"\\(boxed|fbox)\s*\{")
    told = _from_last(MARKS_BEHIND, 1)(_from_last(MARKS_BEFORE, 2)(response))
    inside = _let(told, lambda x: F.coalesce(F.nullif(strip(unboxed(last_boxed(x))), F.lit("")), x))
    answer = _from_last(LEADS, 2)(_from_last((r"\. ",), 1)(inside))
    return _let(answer, lambda x: F.struct((marked & x.rlike("[0-9]")).alias("found"), x.alias("answer")))
