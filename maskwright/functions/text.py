"""Text functions as native columns. Offsets count code points from 0; ranges are half-open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEWLINE = "\n"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: what a lambda names from outside is computed again for every element."""
    return F.transform(F.array(value), body)[0]


def _summed(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda s, x: s + x)


def _blocks(a: Column, size: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / size).cast("int")), lambda k: F.slice(a, k * size + 1, size))


def _short_starts(a: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(a)), lambda i: _summed(F.slice(a, F.lit(1), i - 1)))


def _shifted(blocks: Column, bases: Column) -> Column:
    return F.flatten(F.zip_with(blocks, bases, lambda x, base: F.transform(_short_starts(x), lambda s: s + base)))


def starts(lengths: Column) -> Column:
    """The sum of the lengths before each one, which isn't empty.

    Sums of blocks of blocks: n numbers take some n^(4/3) additions, not n^2.
    """
    root = lambda a, power: F.ceil(F.pow(F.size(a), F.lit(power))).cast("int")

    def bases(blocks):
        sums = F.transform(blocks, _summed)
        return let(sums, lambda s: let(_blocks(s, root(s, 1 / 2)), lambda b: _shifted(b, _short_starts(F.transform(b, _summed)))))

    return let(lengths, lambda a: F.when(F.size(a) <= 32, _short_starts(a)).otherwise(let(_blocks(a, root(a, 1 / 3)), lambda b: _shifted(b, bases(b)))))


def cut(text: Column, bounds: Column) -> Column:
    """The pieces of a text between bounds that rise from 0 to its length.

    A substring is found by counting from the text's start, so bounds are taken
    in blocks, each cut from its own part of the text: some n^(1/2) passes over
    the text for n bounds, not n.
    """

    def pieces_of(b):
        last = F.size(b) - 1
        step = F.ceil(F.sqrt(last)).cast("int")

        def block(k):
            low, high = b[k * step], b[F.least((k + 1) * step, last)]
            inner = F.slice(b, k * step + 1, F.least(step, last - k * step) + 1)
            return let(F.struct(text.substr(low + 1, high - low).alias("t"), F.transform(inner, lambda x: x - low).alias("b")), within)

        def within(part):
            return F.transform(F.sequence(F.lit(1), F.size(part["b"]) - 1), lambda i: part["t"].substr(part["b"][i - 1] + 1, part["b"][i] - part["b"][i - 1]))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.floor((last - 1) / step).cast("int")), block))

    return let(bounds, pieces_of)


def replaced(text: Column, ranges: Column, token) -> Column:
    """The text with ``token(piece, range)`` in place of each of its sorted, disjoint ranges (structs of start and end)."""
    bounds = F.concat(F.array(F.lit(0)), F.flatten(F.transform(ranges, lambda r: F.array(r["start"], r["end"]))), F.array(F.length(text)))

    def woven(x):
        parts, own = x["p"], x["r"]
        new = F.transform(parts, lambda p, i: F.when(i % 2 == 0, p).otherwise(token(p, own[F.floor(i / 2).cast("int")])))
        return F.array_join(new, "")

    return F.when(F.size(ranges) > 0, let(F.struct(cut(text, bounds).alias("p"), ranges.alias("r")), woven)).otherwise(text)


def normalize_markdown(text: Column) -> Column:
    """Line feeds only, blank lines empty, at most one blank line in a row, one line feed at the end; empty stays empty."""
    t = F.regexp_replace(text, r"\r\n?", NEWLINE)
    t = F.regexp_replace(t, r"(?Umd)^[\s\x1c-\x1f&&[^\n]]+$", "")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, r"(?d)\A\n+|\n+\z", "")
    return F.when(t == "", "").otherwise(F.concat(t, F.lit(NEWLINE)))


def collapse_fold(text: Column) -> Column:
    """White space runs as one space, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def strip_all_fold(text: Column) -> Column:
    """Lower case without any white space."""
    return F.lower(F.regexp_replace(text, r"(?U)\s+", ""))


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)[^\w.-]+", "_")


def label_type(key: Column) -> Column:
    """The type in a record key: PERSONAL_ID as it is, otherwise what follows the last underscore; a trailing 2 goes."""
    key = F.regexp_replace(key, "2$", "")
    return F.when(key == "PERSONAL_ID", key).otherwise(F.regexp_extract(key, "[^_]*$", 0))


def truncate_at_line(text: Column, limit: int, suffix: str) -> Column:
    """The text up to the last line feed below the limit (or the limit itself), with a suffix where it was cut."""
    head = F.substring(text, 1, limit)
    at = F.length(head) - F.locate(NEWLINE, F.reverse(head))
    cut = F.when(F.locate(NEWLINE, F.reverse(head)) > 0, F.expr("1") * at).otherwise(F.lit(limit))
    kept = F.regexp_replace(head.substr(F.lit(1), cut.cast("int")), r"(?U)\s+\z", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(kept, F.lit(suffix)))


def clause(text: Column, start: Column, end: Column) -> Column:
    """struct(left, right) of the sentence or field around a range; marks inside the range don't split it."""
    before = text.substr(F.lit(1), start)
    after = text.substr(end + 1, F.length(text))
    left = start - F.length(F.regexp_extract(before, r"[^\n.;!?]*\z", 0))
    right = end + F.length(F.regexp_extract(after, r"\A[^\n.;!?]*", 0))
    return F.struct(left.cast("int").alias("left"), right.cast("int").alias("right"))


def mask(text: Column) -> Column:
    """Every character but line ends as a block, so offsets stay."""
    return F.regexp_replace(text, r"[^\n\r]", "█")


def pieces(text: Column, size: int, overlap: int) -> Column:
    """Fixed windows of ``size`` that overlap: array of struct(offset, piece)."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap in [0, size)")
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / step)) * step
    made = F.transform(F.sequence(F.lit(0), last.cast("int"), F.lit(step)), lambda p: F.struct(p.alias("offset"), text.substr(p + 1, F.lit(size)).alias("piece")))
    return F.when(F.length(text) == 0, F.array().cast("array<struct<offset:int,piece:string>>")).otherwise(made)


def _cut_windows(size: int, overlap: int, marks: str, keep_mark: bool):
    def cut(text: str | None):
        start, out = 0, []
        while text and start < len(text):
            end = min(len(text), start + size)
            if end < len(text):
                at = max(text.rfind(m, start, end) for m in marks)
                if at > start + size // 2:
                    end = at + keep_mark
            out.append((start, text[start:end]))
            if end == len(text):
                break
            start = max(start + 1, end - overlap)
        return out

    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap in [0, size)")
    return F.udf(cut, "array<struct<offset:int,piece:string>>", useArrow=True)


def word_windows(text: Column, size: int = 700, overlap: int = 150) -> Column:
    """Windows that end at the last line feed or space of their second half; each end depends on the one before, so Python walks them."""
    return _cut_windows(size, overlap, "\n ", False)(text)


def line_windows(text: Column, size: int = 100_000, overlap: int = 1000) -> Column:
    """Windows that end after the last line feed of their second half."""
    return _cut_windows(size, overlap, "\n", True)(text)


def cell(value: Column) -> Column:
    """A table cell: trimmed, pipes escaped, line feeds as <br>."""
    v = F.trim(F.coalesce(value, F.lit("")))
    return F.replace(F.replace(v, F.lit("|"), F.lit("\\|")), F.lit(NEWLINE), F.lit("<br>"))


def markdown_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, cell), " | "), F.lit(" |"))


def rows_to_markdown(rows: Column) -> Column:
    """An array of rows of cells as a table: the first is the header, short rows are padded."""
    width = F.array_max(F.transform(rows, F.size))
    padded = F.transform(rows, lambda r: markdown_row(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(padded, 1, 1), F.array(rule), F.slice(padded, F.lit(2), F.greatest(F.size(padded) - 1, F.lit(0)))), NEWLINE))


def distinct_lines(text: Column) -> Column:
    """The white-space-normalised lines of a text, each once where it comes first; blank ones go."""
    return F.array_distinct(F.filter(F.transform(F.split(text, NEWLINE), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))), lambda x: x != ""))


def metadata_section(properties: Column) -> Column:
    """A metadata section from array<struct<name, value>>; values can't forge a heading; null if there is nothing."""
    flat = F.transform(properties, lambda p: F.struct(p["name"].alias("name"), F.trim(F.regexp_replace(p["value"], r"\s*[\r\n]+\s*", " ")).alias("value")))
    full = F.filter(flat, lambda p: F.coalesce(p["value"], F.lit("")) != "")
    lines = F.transform(full, lambda p: F.concat(F.lit("- "), p["name"], F.lit(": "), p["value"]))
    return F.when(F.size(full) > 0, F.concat(F.lit("## Document metadata\n\n"), F.array_join(lines, NEWLINE)))


def expand_box(left: Column, top: Column, width: Column, height: Column) -> Column:
    """A word's box with a margin of a third of its height, 3 at least."""
    pad = F.greatest(F.lit(3), F.floor(height / 3))
    return F.struct((left - pad).alias("left"), (top - pad).alias("top"), (left + width + pad).alias("right"), (top + height + pad).alias("bottom"))


def unscale_box(left: Column, top: Column, width: Column, height: Column, scale: int) -> Column:
    """A box read at a scale of 1, 2 or 3 in source pixels: floor on the near sides, ceiling on the far ones."""
    if scale not in (1, 2, 3):
        raise ValueError("scale: 1, 2 or 3")
    near_x, near_y = F.floor(left / scale), F.floor(top / scale)
    return F.struct(near_x.alias("left"), near_y.alias("top"), (F.ceil((left + width) / scale) - near_x).alias("width"), (F.ceil((top + height) / scale) - near_y).alias("height"))


def business_check_digit(digits: Column) -> Column:
    """The modulo 11 check digit of seven digits; null where the remainder is 1, which is never issued."""
    weights = (7, 9, 10, 5, 8, 4, 2)
    total = sum((digits.substr(i + 1, 1).cast("int") * w for i, w in enumerate(weights)), F.lit(0))
    rest = total % 11
    return F.when(rest == 0, 0).when(rest > 1, 11 - rest)


def is_loopback_endpoint(url: Column) -> Column:
    """Plain http to a loopback address without credentials, query or fragment, path /v1."""
    return F.coalesce(url.rlike(r"^http://(127\.\d{1,3}\.\d{1,3}\.\d{1,3}|\[::1\])(:\d{1,5})?/v1/?$"), F.lit(False))
