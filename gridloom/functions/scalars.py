"""Column functions: addresses, names, messages, labels, sets.  All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the workbook format.
MAX_COLUMN, MAX_ROW = 16384, 1048576


def lit_array(values) -> Column:
    """An array of literals; typed where it is empty."""
    values = list(values)
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def contains_any(text: Column, words) -> Column:
    """Does the text hold any of the words, as plain substrings?"""
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def first_label(text: Column, table, default: str | None = None) -> Column:
    """Label of the first entry (label, words) one of whose words the text holds."""
    out = None
    for label, words in table:
        hit = contains_any(text, words)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(default))


def ordered(*rules: tuple[Column, object], default: object = None) -> Column:
    """The value of the first rule that holds."""
    out = None
    for test, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


# ---- addresses


def column_letters(n: Column) -> Column:
    """1 -> A, 27 -> AA, up to the three letters a sheet can need; null outside 1..18278."""
    n = n.cast("long")
    digit = lambda k: F.char(F.pmod(k, F.lit(26)) + 65)
    a, b, c = n - 1, F.floor((n - 27) / 26), F.floor((n - 703) / 676)
    return ordered(((n < 1) | (n > 18278), F.lit(None).cast("string")), (n <= 26, digit(a)), (n <= 702, F.concat(digit(b), digit(a))), default=F.concat(digit(c), digit(b), digit(a)))


def column_number(letters: Column) -> Column:
    """A -> 1, AA -> 27, case-insensitive."""
    chars = F.split(F.upper(letters), "")
    return F.aggregate(chars, F.lit(0).cast("long"), lambda n, c: n * 26 + F.ascii(c) - 64)


def cell_column(ref: Column) -> Column:
    """Column number of a cell address, by its letters alone."""
    return column_number(F.regexp_replace(ref, "[^A-Za-z]", ""))


_RANGE = r"^\$?([A-Za-z]{1,3})\$?([0-9]{1,7})(?::\$?([A-Za-z]{1,3})\$?([0-9]{1,7}))?$"


def range_bounds(ref: Column) -> Column:
    """Struct of min_col, min_row, max_col, max_row of ``A1`` or ``A1:E41``; null for anything else."""
    part = lambda k: F.regexp_extract(ref, _RANGE, k)
    c1, r1 = column_number(part(1)), part(2).cast("long")
    other = part(3) != ""
    c2 = F.when(other, column_number(part(3))).otherwise(c1)
    r2 = F.when(other, F.try_to_number(part(4), F.lit("9999999")).cast("long")).otherwise(r1)
    box = F.struct(F.least(c1, c2).alias("min_col"), F.least(r1, r2).alias("min_row"), F.greatest(c1, c2).alias("max_col"), F.greatest(r1, r2).alias("max_row"))
    return F.when(ref.rlike(_RANGE), box)


def range_ref(top: Column, left: Column, bottom: Column, right: Column) -> Column:
    """``A1:E41``."""
    return F.concat(column_letters(left), top.cast("string"), F.lit(":"), column_letters(right), bottom.cast("string"))


# ---- messages and names


def redacted_message(message: Column, path: Column) -> Column:
    """A message with its path cut to the file's name, other local paths and secrets replaced, at most 240 characters."""
    name = F.regexp_extract(path, r"[^/\\]*$", 0)
    out = F.when(path.isNotNull() & (path != ""), F.replace(message, path, name)).otherwise(message)
    # fixed values: local paths, and settings that hold secrets
    out = F.regexp_replace(out, r"""(?:[A-Za-z]:\\|/(?:Users|home|tmp|var|mnt|private|Volumes)/)[^\s"'<>|]+""", "[local path]")
    out = F.regexp_replace(out, r"(?i)\b(password|pwd|token|secret|api[_-]?key|uid|user id)\s*=\s*[^;\s]+", "$1=[redacted]")
    return F.left(out, F.lit(240))


def scan_error(category: Column, message: Column) -> Column:
    """``category: message``, without an empty half; N/A where both are empty."""
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(full(F.concat_ws(": ", full(category), full(message))), F.lit("N/A"))


def external_name(path: Column) -> Column:
    """The file's name of a path or address: decoded, without query and fragment, blanks collapsed."""
    text = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    text = F.regexp_extract(text, r"^[^?#]*", 0)
    text = F.regexp_replace(text, r"^[A-Za-z][A-Za-z0-9+.-]+://[^/]*", "")
    text = F.regexp_replace(F.translate(text, "\\", "/"), "/+$", "")
    name = F.regexp_extract(text, r"[^/]*$", 0)
    name = F.trim(F.regexp_replace(F.translate(name, "%", " "), r"\s+", " "))
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("unnamed workbook"))


#: Fixed value: what in a name may give away a place, an account or a secret.
SENSITIVE = r"(?i)[/\\:@]|password=|server=|uid=|provider=|database=|token=|api[_-]?key="


def connection_label(name: Column, kind: Column) -> Column:
    """A connection's name where it gives nothing away, else its type, else a fixed label."""
    safe = lambda c: (F.trim(c) != "") & ~c.rlike(SENSITIVE)
    return ordered((safe(name), F.left(F.trim(name), F.lit(80))), (safe(kind), F.concat(F.trim(kind), F.lit(" connection"))), default="unnamed connection")


def spreadsheet_safe(value: Column) -> Column:
    """A quote before text that a spreadsheet would take for a formula."""
    return F.when(F.regexp_replace(value, r"^\s+", "").rlike(r"^[=+\-@]"), F.concat(F.lit("'"), value)).otherwise(value)


def visibility(state: Column) -> Column:
    """visible, hidden, veryHidden as shown to reviewers."""
    return ordered((state == "hidden", "Hidden"), (state == "veryHidden", "Very Hidden"), default="Visible")


def error_entry(entry: Column) -> Column:
    """Struct of sheet, cell and error of ``Sheet!C5 #DIV/0!``; ``#UNKNOWN`` where the rest has another form."""
    sheet = F.substring_index(entry, "!", 1)
    rest = F.when(entry.contains("!"), F.substring(entry, F.length(sheet) + 2, F.length(entry))).otherwise("")
    form = r"^([A-Za-z]{1,3}[0-9]{1,7}) (#[A-Z0-9/!?]+)$"
    known = rest.rlike(form)
    return F.struct(sheet.alias("sheet"), F.when(known, F.regexp_extract(rest, form, 1)).otherwise(rest).alias("cell"), F.when(known, F.regexp_extract(rest, form, 2)).otherwise("#UNKNOWN").alias("error"))


def months_since(stamp: Column, now: Column) -> Column:
    """Whole months of 30 days between a time stamp as text and now; null where it can't be read."""
    days = F.datediff(now, F.try_to_timestamp(stamp))
    return F.greatest(F.lit(0), F.floor(days / 30)).cast("long")


def months_or_null(stamp: Column, now: Column) -> Column:
    return F.when(F.try_to_timestamp(stamp).isNotNull(), months_since(stamp, now))


# ---- cells


def number_of(text: Column) -> Column:
    """The text as a number, null where it is none."""
    return text.try_cast("double")


def looks_like_date(code: Column) -> Column:
    """Does a number format render a date: any of y m d h s outside quotes and brackets?"""
    bare = F.regexp_replace(F.lower(code), r'"[^"]*"?|\[[^\]]*\]?', "")
    return bare.rlike("[ymdhs]")


#: Built-in date formats, a fixed list of the workbook format.
DATE_FORMATS = (14, 15, 16, 17, 18, 19, 20, 21, 22, 27, 30, 36, 45, 46, 47, 50, 57)


def typed_cell(kind: Column, raw: Column, formula: Column, date_style: Column) -> Column:
    """Flags of a cell by its type letter and text: shared or inline string, boolean, error, date or number."""
    text_kind = kind.isin("s", "str", "inlineStr")
    error, boolean = kind == "e", kind == "b"
    other = ~text_kind & ~error & ~boolean
    number = number_of(raw)
    dated = (kind == "d") | (other & (kind != "d") & number.isNotNull() & date_style)
    is_number = other & (kind != "d") & number.isNotNull() & ~date_style
    text = (text_kind | error | (other & (kind != "d") & number.isNull())) & raw.isNotNull()
    return F.struct(
        F.coalesce(text, F.lit(False)).alias("is_text"),
        F.coalesce(is_number, F.lit(False)).alias("is_number"),
        F.coalesce(dated, F.lit(False)).alias("is_date"),
        F.coalesce(error, F.lit(False)).alias("is_error"),
        (formula.isNotNull() & (formula != "")).alias("is_formula"),
        F.coalesce((number == F.floor(number)), F.lit(False)).alias("is_integral"),
    )


def occupancy_flag(is_error: Column, is_formula: Column, is_text: Column) -> Column:
    """3 an error, 2 a formula, 4 text, 1 another value."""
    return ordered((is_error, 3), (is_formula, 2), (is_text, 4), default=1)


def density(populated: Column, max_row: Column, max_col: Column) -> Column:
    """Share of the used rectangle that is populated, four places; 0 for an empty one."""
    return F.coalesce(F.round(F.try_divide(populated.cast("double"), (max_row * max_col).cast("double")), 4), F.lit(0.0))


# ---- sets and vectors


def header_tokens(headers: Column, filtered: bool = True) -> Column:
    """Distinct lower-cased parts of ``parent::child`` headers, sorted; ``filtered``: two letters at least, no plain numbers."""
    parts = F.transform(F.flatten(F.transform(F.filter(headers, lambda h: h.isNotNull()), lambda h: F.split(h, "::"))), lambda p: F.lower(F.trim(p)))
    keep = (lambda p: (F.length(p) >= 2) & ~p.rlike("^[0-9]+$")) if filtered else (lambda p: p != "")
    return F.array_sort(F.array_distinct(F.filter(parts, keep)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two sets; 0 where either is empty."""
    shared, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / union)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 where either has no length."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda n, x: n + x)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = lambda v: F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))
