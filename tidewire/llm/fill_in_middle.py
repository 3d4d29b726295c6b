"""Fill-in-middle texts by escaped marker injection: a delimiter goes after each unit of a text, and parts are cut by its rank.

Only SQL functions: no text leaves the JVM, and a text is handled on its own, so nothing shuffles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fresh

#: The delimiter, and the sign that escapes both itself (as ``e``) and the delimiter (as ``d``) in a text.
DELIMITER, ESCAPE = "\x01", "\x02"
CODE_POINT = "(?s:.)"


def escaped(text: Column) -> Column:
    once = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "e"))
    return F.replace(once, F.lit(DELIMITER), F.lit(ESCAPE + "d"))


def unescaped(text: Column) -> Column:
    """The text that ``escaped`` was given, from a part of its marked form: delimiters go, escaped signs come back."""
    plain = F.replace(text, F.lit(DELIMITER), F.lit(""))
    once = F.replace(plain, F.lit(ESCAPE + "d"), F.lit(DELIMITER))
    return F.replace(once, F.lit(ESCAPE + "e"), F.lit(ESCAPE))


def marked(text: Column, unit: str = CODE_POINT) -> Column:
    """The escaped text with the delimiter after every match of ``unit``; an escaped sign is a unit of its own."""
    return F.regexp_replace(escaped(text), f"\\x02[de]|{unit}", "$0\x01")


def units(mark: Column) -> Column:
    """How many delimiters a marked text has; the delimiter is one byte in UTF-8."""
    return (F.octet_length(mark) - F.octet_length(F.replace(mark, F.lit(DELIMITER), F.lit("")))).cast("long")


def _ranked(mark: Column, count: Column) -> Column:
    """What is before the delimiter of rank ``count``, or from the end after it if that is negative; the rank may be a column."""
    return F.call_function("substring_index", mark, F.lit(DELIMITER), count.cast("int"))


def _part(mark: Column, start: Column, end: Column | None = None) -> Column:
    """The units from rank ``start`` up to ``end`` of a marked text; without an end also what follows the last unit."""
    if end is None:
        return unescaped(_ranked(mark, start - units(mark) - 1))
    return unescaped(_ranked(_ranked(mark, end), start - end))


def restored(output: Column, form: Column, markers: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The text that an output was made of. A cut text holds no marker, so the first of each in the output is the one put in."""
    p, s, m = markers

    def after(text: Column, marker: str) -> Column:
        return F.substr(text, F.instr(text, marker) + len(marker))

    def before(text: Column, marker: str) -> Column:
        return F.substring_index(text, marker, 1)

    rest = after(output, s)
    psm = F.concat(before(after(output, p), s), after(rest, m), before(rest, m))
    last = after(rest, p)
    spm = F.concat(before(last, m), after(last, m), before(rest, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(df: DataFrame, unit: str = CODE_POINT, markers: tuple[str, str, str] = ("<P>", "<S>", "<M>"), plain: int = 10, spm: int = 20, seed: str = "1") -> DataFrame:
    """Adds n, form, prefix_chars, middle_chars and output to every row: its text, cut at two places and put in another order.

    ``unit`` is a Java pattern; cuts fall only after its matches, and what follows the last goes to the suffix. n counts
    them. ``plain`` percent of texts, empty ones, and those that hold a marker stay as they are (form ``plain``, lengths
    null); of the others ``spm`` percent put the suffix first. All choices come from the SHA-256 of seed, colon and doc_id,
    so equal ids choose alike. A null text counts as empty, a null doc_id as the empty id. Repeated rows stay, an empty
    table stays empty, columns named as an output are replaced, other columns stay.
    """
    df = df.drop(*[c for c in df.columns if c.lower() in ("n", "form", "prefix_chars", "middle_chars", "output")])
    mark, draws, lo, hi, before, middle, after = (fresh(df, c) for c in ("mark", "draws", "lo", "hi", "before", "middle", "after"))
    p, s, m = markers
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draw = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    holds = reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in markers])
    form = F.when((text == "") | holds | (F.col(draws)[2] % 100 >= 100 - plain), "plain").when(F.col(draws)[3] % 100 < spm, "spm").otherwise("psm")
    made = df.withColumns({mark: marked(text, unit), draws: F.array(*draw)}).withColumns({"n": units(F.col(mark)), "form": form})
    first, second = F.col(draws)[0] % (F.col("n") + 1), F.col(draws)[1] % (F.col("n") + 1)
    made = made.withColumns({lo: F.least(first, second), hi: F.greatest(first, second)})
    cut = F.col("form") != "plain"
    parts = {before: _part(F.col(mark), F.lit(0), F.col(lo)), middle: _part(F.col(mark), F.col(lo), F.col(hi)), after: _part(F.col(mark), F.col(hi))}
    made = made.withColumns({name: F.when(cut, part) for name, part in parts.items()})
    psm = F.concat(F.lit(p), F.col(before), F.lit(s), F.col(after), F.lit(m), F.col(middle))
    spm_form = F.concat(F.lit(s), F.col(after), F.lit(p), F.col(before), F.lit(m), F.col(middle))
    made = made.withColumns({
        "prefix_chars": F.char_length(F.col(before)).cast("long"), "middle_chars": F.char_length(F.col(middle)).cast("long"),
        "output": F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_form).otherwise(text),
    })
    return made.select(*df.columns, "n", "form", "prefix_chars", "middle_chars", "output")
