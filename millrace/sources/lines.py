"""Text lines of several formats: valid ones become examples, the others are kept whole with the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.ids import MAX_UNSIGNED, from_digits, token_id

SPACE = " \t\r\n"
NUMBER = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
INTEGER = r"\A[+-]?[0-9]+\z"
DIGITS = r"\A[0-9]+\z"
LARGEST = 1.7976931348623157e308
INTEGERS, TOKENS = 13, 26
#: Columns that the built-in reader takes at most; a line with more can't be read, and so is corrupt.
MOST_COLUMNS = 20_480
GROUPS = 4095
#: Marks that stand in for characters inside a field while it is cut out of its line; the mark itself is doubled so that nothing is lost.
MARK, MARKED = "\x01", (("\x01", "\x01a"), ("\t", "\x01b"), ("\r", "\x01c"), ("\n", "\x01d"))


def is_number(x: Column) -> Column:
    return x.rlike(NUMBER) & (F.abs(x.try_cast("double")) <= LARGEST)


def is_id(x: Column) -> Column:
    """ASCII digits, below 2^64."""
    bare = F.ltrim(x, F.lit("0"))
    return x.rlike(DIGITS) & ((F.length(bare) < 20) | ((F.length(bare) == 20) & (bare <= MAX_UNSIGNED)))


def small(x: Column, most: int) -> Column:
    """ASCII digits of at most so much."""
    bare = F.ltrim(x, F.lit("0"))
    return x.rlike(DIGITS) & (F.length(bare) <= len(str(most))) & (F.coalesce(bare.try_cast("bigint"), F.lit(0)) <= most)


def _replaced(x: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for a, b in pairs:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def _pieces(line: Column) -> Column:
    """The line cut at every double quote; pieces at odd places lie inside quotes."""
    return F.split(line, '"', -1)


def _quoted_well(pieces: Column) -> Column:
    """Every quote closes, opens at a field's start and closes at its end. An empty piece between two quotes is an escaped quote."""
    last = F.size(pieces) - 1
    outside = F.transform(pieces, lambda x, i: (i % 2 == 1) | (x == "") | (((i == 0) | x.startswith("\t")) & ((i == last) | x.endswith("\t"))))
    return (last % 2 == 0) & F.forall(outside, lambda x: x)


def _encoded(pieces: Column) -> Column:
    """The line with tabs inside quotes, line ends and marks replaced, so that every tab left parts two fields."""
    return F.array_join(F.transform(pieces, lambda x, i: F.when(i % 2 == 1, _replaced(x, MARKED)).otherwise(_replaced(x, tuple(p for p in MARKED if p[0] != "\t")))), '"')


def _read(text: Column, names: list[str]) -> Column:
    """The fields of a line, read permissively under an explicit schema; a line with more or fewer fields keeps its text in corrupt."""
    schema = ", ".join(f"{x} string" for x in [*names, "corrupt"])
    options = {"sep": "\t", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt", "maxCharsPerColumn": "-1", "maxColumns": str(MOST_COLUMNS), "nullValue": "", "emptyValue": ""}
    return F.from_csv(text, F.lit(schema), options)


def _field(read: Column, name: str) -> Column:
    return _replaced(F.coalesce(read[name], F.lit("")), tuple((b, a) for a, b in reversed(MARKED)))


def _first(*cases: tuple[Column, str]) -> Column:
    """The first reason whose case holds; a case that is null doesn't."""
    out = F.when(F.coalesce(cases[0][0], F.lit(False)), cases[0][1])
    for case, reason in cases[1:]:
        out = out.when(F.coalesce(case, F.lit(False)), reason)
    return out


def _tokens(raw: Column) -> Column:
    return F.split(F.btrim(raw, F.lit(SPACE)), f"[{SPACE}]+", -1)


def _halves(token: Column) -> Column:
    """idx, and what stands after the first colon (null where there is none)."""
    at = F.instr(token, ":")
    return F.struct(F.when(at > 0, F.left(token, at - 1)).otherwise(token).alias("idx"), F.when(at > 0, F.substr(token, at + 1)).alias("rest"))


def _finite(x: Column) -> Column:
    return F.when(is_number(x), x.try_cast("double"))


def _libsvm(tokens: Column) -> Column:
    """label, items and whether the tokens fit the schema: label double, items of idx, val."""
    items = F.transform(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), _halves)
    typed = F.transform(items, lambda x: F.struct(F.when(is_id(x["idx"]), from_digits(x["idx"])).alias("idx"), _finite(x["rest"]).alias("val"), x["rest"].isNotNull().alias("given")))
    return F.struct(_finite(F.element_at(tokens, 1)).alias("label"), typed.alias("items"))


def _adfea(tokens: Column) -> Column:
    """label and items, as of libsvm; val is the group."""
    items = F.transform(F.slice(tokens, 4, F.greatest(F.size(tokens) - 3, F.lit(0))), _halves)
    group = lambda x: F.when(small(x["rest"], GROUPS), x["rest"].try_cast("double"))
    typed = F.transform(items, lambda x: F.struct(F.when(is_id(x["idx"]), from_digits(x["idx"])).alias("idx"), group(x).alias("val"), F.lit(True).alias("given")))
    label = F.get(tokens, F.lit(2))
    return F.struct(F.when(label.isin("0", "1"), label.try_cast("double")).alias("label"), typed.alias("items"))


def _counted(tokens: Column) -> Column:
    """An adfea line's count is that of its items."""
    count = F.get(tokens, F.lit(1))
    bare = F.ltrim(count, F.lit("0"))
    return F.coalesce((F.size(tokens) >= 3) & count.rlike(DIGITS) & (F.when(bare == "", "0").otherwise(bare) == (F.size(tokens) - 3).cast("string")), F.lit(False))


def _criteo(read: Column, names: list[str]) -> Column:
    """label and tokens: the fields of a line as it was read, label null where it is no number, tokens null where one is not as the schema says."""
    labelled = names[0] == "label"
    fields = F.array(*(_field(read, x) for x in names[labelled:]))
    good = F.forall(F.slice(fields, 1, INTEGERS), lambda x: (x == "") | F.coalesce(x.rlike(INTEGER) & x.try_cast("bigint").isNotNull(), F.lit(False))) & F.forall(F.slice(fields, INTEGERS + 1, TOKENS), lambda x: (x == "") | (F.length(x) == 8))
    return F.struct((_finite(_field(read, "label")) if labelled else F.lit(0.0)).alias("label"), F.when(good, fields).alias("fields"))


FORMATS = ("libsvm", "adfea", "criteo", "criteo_test")
COLUMNS = [f"i{k}" for k in range(INTEGERS)] + [f"c{k}" for k in range(TOKENS)]


def parse_lines(lines: DataFrame) -> DataFrame:
    """Every line once: line_id, file_name, fmt, raw, reason, label, features (array of idx, val).

    Valid lines have a null reason; the others have null label and features and their text in raw, whole. Reasons, of which the first counts: empty
    (null, or blanks only), format (fmt is null or none of FORMATS), quoting, columns, label, index, value. The formats' rules are in TESTDATA.md, problem 5.
    An idx:val item without a value has a null val, which means 1. Ids of 2^63 and more keep their bits and look negative. Text tokens become
    token_id(token, field). Lines are judged one by one: repeated lines come out as often as they stand, an empty table gives no row, extra columns
    are ignored. One pass of built-in expressions, linear in the line's length; nothing is shuffled.

    Each line is first read permissively under its format's schema: tab-separated ones by the built-in reader, the others as label and typed items. What the schema can't hold is
    null, and a line of which any part is so, or whose width is wrong, keeps its text as corrupt. So do tab-separated lines with quotes or line ends in them, as the
    reader is lenient with those. Only corrupt lines are then classified: by quoting, by count, and by casts, for which a tab-separated line whose quotes are
    right is read again with what its quotes protect replaced by marks; it may turn out valid.
    """
    fmt, raw = F.col("fmt"), F.col("raw")
    empty = F.coalesce(F.btrim(raw, F.lit(SPACE)) == "", F.lit(True))
    known = F.coalesce(fmt.isin(*FORMATS), F.lit(False))
    rows = lines.select("line_id", "file_name", "fmt", "raw", F.when(empty, "empty").when(~known, "format").alias("early"))
    open_ = F.col("early").isNull()
    names = {"criteo": ["label", *COLUMNS], "criteo_test": COLUMNS}
    tabbed, spaced = open_ & fmt.isin(*names), open_ & fmt.isin("libsvm", "adfea")
    # One step each, as what is used more than once in a later step is then made only once.
    step = rows.withColumns({"tokens": F.when(spaced, _tokens(raw)), "line": F.when(tabbed, F.regexp_replace(raw, r"[\r\n]+\z", ""))})
    odd = F.col("line").rlike('["\r\n\x01]') | (F.length("line") - F.length(F.replace("line", F.lit("\t"), F.lit(""))) >= MOST_COLUMNS)
    step = step.withColumn("plain", F.when(~odd, F.col("line")))
    step = step.withColumns({"libsvm": F.when(open_ & (fmt == "libsvm"), _libsvm(F.col("tokens"))), "adfea": F.when(open_ & (fmt == "adfea"), _adfea(F.col("tokens")))} | {x: F.when(open_ & (fmt == x), _read(F.col("plain"), n)) for x, n in names.items()})
    step = step.withColumns({f"{x}_read": F.when(F.col("plain").isNotNull() & F.col(x)["corrupt"].isNull(), _criteo(F.col(x), n)) for x, n in names.items()})
    quoted = F.contains("raw", F.lit('"'))
    no_id, no_value = (lambda x: x["idx"].isNull()), (lambda x: x["given"] & x["val"].isNull())
    fits = {x: F.col(x)["label"].isNotNull() & ~F.exists(F.col(x)["items"], lambda x: no_id(x) | no_value(x)) & ~quoted for x in ("libsvm", "adfea")}
    fits["adfea"] = fits["adfea"] & _counted(F.col("tokens"))
    fits |= {x: F.coalesce(F.col(f"{x}_read")["label"].isNotNull() & F.col(f"{x}_read")["fields"].isNotNull(), F.lit(False)) for x in names}
    step = step.withColumn("corrupt", F.when(open_ & ~_by_format(fits), raw))
    # From here on only corrupt lines are worked on.
    bad = F.col("corrupt").isNotNull()
    step = step.withColumn("pieces", F.when(bad & tabbed, _pieces(F.col("line"))))
    step = step.withColumns({"well": _quoted_well(F.col("pieces")), "text": _encoded(F.col("pieces"))})
    step = step.withColumn("n", F.length("text") - F.length(F.replace("text", F.lit("\t"), F.lit(""))) + 1)
    again = {f"{x}_again": F.when((fmt == x) & F.col("well") & (F.col("n") == len(n)), _read(F.col("text"), n)) for x, n in names.items()}
    step = step.withColumns(again)
    step = step.withColumns({f"{x}_typed": F.when(F.col(f"{x}_again").isNotNull(), _criteo(F.col(f"{x}_again"), n)) for x, n in names.items()})
    items = {x: [(F.col(x)["label"].isNull(), "label"), (F.exists(F.col(x)["items"], no_id), "index"), (F.exists(F.col(x)["items"], no_value), "value")] for x in ("libsvm", "adfea")}
    reasons = {"libsvm": _first((quoted, "quoting"), *items["libsvm"]), "adfea": _first((quoted, "quoting"), (~_counted(F.col("tokens")), "columns"), *items["adfea"])}
    reasons |= {x: _first((~F.col("well"), "quoting"), ((F.col("n") != len(n)) | F.col(f"{x}_again")["corrupt"].isNotNull(), "columns"), (F.col(f"{x}_typed")["label"].isNull(), "label"), (F.col(f"{x}_typed")["fields"].isNull(), "value")) for x, n in names.items()}
    step = step.withColumn("reason", F.coalesce(F.col("early"), F.when(bad, _by_format(reasons))))
    whole = {x: F.when(bad, F.col(f"{x}_typed")).otherwise(F.col(f"{x}_read")) for x in names}
    tokens = lambda x: F.filter(F.transform(whole[x]["fields"], lambda f, k: F.struct(f.alias("token"), k.alias("k"))), lambda f: f["token"] != "")
    features = {"libsvm": F.transform(F.col("libsvm")["items"], lambda x: F.struct(x["idx"].alias("idx"), x["val"].alias("val")))}
    none = F.lit(None).cast("double").alias("val")
    features["adfea"] = F.transform(F.col("adfea")["items"], lambda x: F.struct(F.shiftleft(x["idx"], 12).bitwiseOR(x["val"].cast("bigint")).alias("idx"), none))
    features |= {x: F.transform(tokens(x), lambda f: F.struct(token_id(f["token"], f["k"]).alias("idx"), none)) for x in names}
    labels = {x: F.col(x)["label"] for x in ("libsvm", "adfea")} | {x: whole[x]["label"] for x in names}
    good = F.col("reason").isNull()
    # Generated columns can't be substituted into a later filter, so no line is parsed twice.
    out = F.explode(F.array(F.struct("reason", F.when(good, _by_format(labels)).alias("label"), F.when(good, _by_format(features)).alias("features")))).alias("x")
    return step.select("line_id", "file_name", "fmt", "raw", out).select("line_id", "file_name", "fmt", "raw", "x.*")


def _by_format(columns: dict[str, Column]) -> Column:
    out = None
    for x, c in columns.items():
        out = F.when(F.col("fmt") == x, c) if out is None else out.when(F.col("fmt") == x, c)
    return out


def rejects(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNotNull()).select("line_id", "file_name", "fmt", "reason", "raw")


def examples(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNull()).select("line_id", "fmt", "label", "features")
