"""Replace personal data by keyed pseudonyms of the same format, in Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lamella.llm.common import unused

#: What is looked for: name and pattern. Numbers and dates count only where ``_valid`` agrees. Java's matcher recurses
#: over repeated groups, so each repetition of one has a bound; a name has at most 64 characters and a domain 126 dots, as in mail and DNS.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,125}\.[A-Za-z]{2,63}",
    "date": r"(?<![0-9A-Za-z.-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9A-Za-z-])",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "card": r"(?<![0-9A-Za-z.])(?:[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})(?![0-9A-Za-z])",
}
#: Country codes of one and of two digits; all others have three.
SHORT_CODES = r"^(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
ROUNDS = 8
#: Parts of a text that are put together at a time.
CHUNK = 64
#: Days from 1800-01-01: 400 Gregorian years are 146097 = 189 x 773 days.
FIRST_DAY, DAY_RADIX = "1800-01-01", (189, 773)


def _digest(key: str, tag: str, turn: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), turn.cast("string"), half), 512)


def _number(digest: Column, at: int | Column, width: int) -> Column:
    return F.conv(F.substring(digest, F.lit(at) if isinstance(at, int) else at, F.lit(width)), 16, 10).cast("long")


def _chars(s: Column) -> Column:
    return F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(s, i, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def _shifted(s: Column, digest: Column) -> Column:
    """Each digit and letter of ``s`` moved inside its class by its share of ``digest``."""

    def move(c: Column, i: Column) -> Column:
        k = _number(digest, F.pmod(i, F.lit(32)) * 4 + 1, 4)
        code = F.ascii(c).cast("long")
        turned = lambda first, n: F.char(F.lit(first) + F.pmod(code - first + k, F.lit(n)))
        return F.when(c.between("0", "9"), turned(48, 10)).when(c.between("a", "z"), turned(97, 26)).when(c.between("A", "Z"), turned(65, 26)).otherwise(c)

    return F.array_join(F.transform(_chars(s), move), "")


def permuted_text(s: Column, key: str, tag: str) -> Column:
    """A Feistel permutation of the strings that have the format of ``s``; other characters stay."""
    cut = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substring(s, F.lit(1), cut).alias("a"), F.substring(s, cut + 1, F.length(s)).alias("b"))
    end = F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), start,
        lambda x, turn: F.struct(x["b"].alias("a"), _shifted(x["a"], _digest(key, tag, turn, x["b"])).alias("b")),
    )
    return F.concat(end["a"], end["b"])


def permuted_number(n: Column, radix: tuple[int, int], key: str, tag: str) -> Column:
    """A permutation of ``0 .. a*b-1`` for ``radix`` (a, b): a Feistel network over the two digits."""
    a, b = radix
    start = F.struct(F.floor(n / b).cast("long").alias("x"), F.pmod(n, F.lit(b)).cast("long").alias("y"))

    def turn(s: Column, i: Column) -> Column:
        x = F.pmod(s["x"] + _number(_digest(key, tag + "x", i, s["y"].cast("string")), 1, 12), F.lit(a))
        moved = F.struct(x.alias("x"), s["y"].alias("y"))
        return F.transform(F.array(moved), lambda m: F.struct(m["x"].alias("x"), F.pmod(m["y"] + _number(_digest(key, tag + "y", i, m["x"].cast("string")), 1, 12), F.lit(b)).alias("y")))[0]

    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)
    return end["x"] * b + end["y"]


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn_sum(digits: Column, doubled_parity: int) -> Column:
    """Sum over digits from the right; those at ``doubled_parity`` (0 or 1) count twice, digitwise."""
    values = F.transform(_chars(F.reverse(digits)), lambda c: c.cast("int"))
    parts = F.transform(values, lambda v, i: F.when(i % 2 == doubled_parity, v * 2 - F.when(v > 4, 9).otherwise(0)).otherwise(v))
    return F.aggregate(parts, F.lit(0), lambda acc, v: acc + v)


def _refilled(s: Column, digits: Column) -> Column:
    """``s`` with its digits, in order, replaced by those of ``digits``."""
    step = lambda acc, c: F.when(c.between("0", "9"), F.struct(F.concat(acc["out"], F.substring(digits, acc["n"], F.lit(1))).alias("out"), (acc["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["n"].alias("n")))
    return F.aggregate(_chars(s), F.struct(F.lit("").alias("out"), F.lit(1).alias("n")), step)["out"]


def _valid(kind: str, s: Column) -> Column:
    if kind == "date":
        return s.try_cast("date").between(F.lit(FIRST_DAY).cast("date"), F.lit("2199-12-31").cast("date"))
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda o: o.cast("int") <= 255)
    if kind == "phone":
        return F.length(_digits(s)).between(10, 15)
    if kind == "ssn":
        return ~s.rlike("^(000|666|9)|-00-|-0000$")
    if kind == "card":
        return F.length(_digits(s)).between(13, 19) & (_luhn_sum(_digits(s), 1) % 10 == 0)
    return F.lit(True)


def _pseudonym(kind: str, s: Column, key: str) -> Column:
    if kind == "date":
        day = permuted_number(F.datediff(s.try_cast("date"), F.lit(FIRST_DAY).cast("date")).cast("long"), DAY_RADIX, key, kind)
        return F.date_add(F.lit(FIRST_DAY).cast("date"), day.cast("int")).cast("string")
    if kind == "ip":
        value = F.aggregate(F.split(s, r"\."), F.lit(0).cast("long"), lambda acc, o: acc * 256 + o.cast("long"))
        moved = F.array(permuted_number(value, (65536, 65536), key, kind))
        return F.transform(moved, lambda v: F.concat_ws(".", *[(F.shiftright(v, n) % 256).cast("string") for n in (24, 16, 8, 0)]))[0]
    if kind == "ssn":
        area, group, serial = (F.split(s, "-")[i].cast("long") for i in range(3))
        index = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1
        moved = F.array(permuted_number(index, (898, 99 * 9999), key, kind))
        first = lambda v: F.floor(v / (99 * 9999)).cast("long")
        return F.transform(moved, lambda v: F.format_string("%03d-%02d-%04d", first(v) + F.when(first(v) >= 665, 2).otherwise(1), F.floor(v / 9999).cast("long") % 99 + 1, v % 9999 + 1))[0]
    if kind == "card":
        body = permuted_text(F.substring(_digits(s), F.lit(1), F.length(_digits(s)) - 1), key, kind)
        return F.transform(F.array(body), lambda b: _refilled(s, F.concat(b, F.pmod(-_luhn_sum(b, 0), F.lit(10)).cast("string"))))[0]
    if kind == "phone":

        def dialled(d: Column) -> Column:
            code = F.when(d.rlike(SHORT_CODES), F.regexp_extract(d, SHORT_CODES, 0)).otherwise(F.substring(d, 1, 3))
            return F.transform(F.array(code), lambda c: _refilled(s, F.concat(c, permuted_text(F.substring(d, F.length(c) + 1, F.length(d)), key, kind))))[0]

        return F.transform(F.array(_digits(s)), dialled)[0]
    name = F.substring_index(s, "@", 1)
    return F.concat(permuted_text(name, key, kind), F.substring(s, F.length(name) + 1, F.length(s)))


def _judged(s: Column) -> Column:
    """The kind of a candidate, null if it only looks like one."""
    out = None
    for kind, pattern in KINDS.items():
        fits, found = s.rlike(f"^(?:{pattern})$"), F.when(_valid(kind, s), F.lit(kind))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out


def _replaced(kind: Column, s: Column, key: str) -> Column:
    out = None
    for k in KINDS:
        out = F.when(kind == k, _pseudonym(k, s, key)) if out is None else out.when(kind == k, _pseudonym(k, s, key))
    return out


def _woven(parts: Column) -> Column:
    """The text of ``parts`` (text up to the next candidate; the candidate it begins with, if any, its kind and its pseudonym), and counts by kind.

    From left to right a valid candidate is replaced unless it begins inside one replaced before. ``left``
    is how many characters of the last replaced one are still to come; finished text is put aside in
    chunks, so that long lists are never copied part by part.
    """
    start = F.struct(
        F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("left"),
        *[F.lit(0).cast("long").alias(f"n_{k}") for k in KINDS],
    )

    def step(state: Column, part: Column) -> Column:
        size = F.length(part["text"])
        taken = (state["left"] == 0) & part["kind"].isNotNull()
        gone = F.when(taken, F.length(part["found"])).otherwise(state["left"])
        rest = F.when(gone < size, F.substring(part["text"], gone + 1, size)).otherwise("")
        new = F.concat(F.when(taken, part["pseudonym"]).otherwise(""), rest)
        full = F.size(state["open"]) >= CHUNK
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(F.array_join(state["open"], "")))).otherwise(state["done"]).alias("done"),
            F.when(full, F.array(new)).otherwise(F.concat(state["open"], F.array(new))).alias("open"),
            F.greatest(gone - size, F.lit(0)).alias("left"),
            *[(state[f"n_{k}"] + F.when(taken & (part["kind"] == k), 1).otherwise(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        )

    return F.aggregate(parts, start, step, lambda s: F.struct(F.array_join(F.concat(s["done"], s["open"]), "").alias("text"), *[s[f"n_{k}"].alias(f"n_{k}") for k in KINDS]))


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Replace personal data in ``text``; add ``n_<kind>`` counts of what was replaced, for each of ``KINDS``.

    Each value is permuted by a keyed Feistel network inside its own format: digits stay digits,
    letters stay letters of their case, a card number keeps a right check digit, an address its four
    bytes, a date is another date of the years 1800-2199. Equal values get equal pseudonyms in every
    document, different ones different; a phone number gets the same digits however it is spaced. The
    domain of an email and the country code of a phone stay. Numbers that only look like cards,
    addresses or dates (bad check digit, byte over 255, 30 February) are left alone, and what begins
    inside such a number is still judged on its own. Of valid values that overlap, the leftmost is replaced.

    Cards are digits in one run or in groups of 4-4-4 and the rest, or 4-6-4 or 4-6-5. A name of over 64 characters is none; a domain
    is read up to its 127th label. Null text stays null with counts 0; empty text stays empty. Rows, order and
    other columns are kept, whatever their names; columns called n_<kind> are replaced. No rows give none. There is no shuffle.
    """
    pattern = "|".join(f"(?:{p})" for p in KINDS.values())
    source = F.col(f"`{text}`")

    def parts_of(found: Column) -> Column:
        # the text is split where candidates begin; what stands before the first one has none
        pieces = F.split(source, f"(?=(?:{pattern}))", -1)
        own = F.when(F.size(pieces) > F.size(found), F.concat(F.array(F.lit(None).cast("string")), found)).otherwise(found)
        judged = F.transform(own, lambda s: F.struct(s.alias("found"), _judged(s).alias("kind")))
        return F.zip_with(pieces, judged, lambda p, c: F.struct(p.alias("text"), c["found"].alias("found"), c["kind"].alias("kind"), _replaced(c["kind"], c["found"], key).alias("pseudonym")))

    found = F.when(source.rlike("[0-9@]"), F.regexp_extract_all(source, F.lit(f"(?=({pattern}))"), F.lit(1)))
    result = F.transform(F.array(found), lambda f: F.when(F.size(f) > 0, _woven(parts_of(f))))[0]
    held = unused("found", docs.columns)
    rows = docs.withColumn(held, result)
    counts = {f"n_{k}": F.coalesce(F.col(f"{held}.n_{k}"), F.lit(0)).cast("long") for k in KINDS}
    return rows.withColumns({text: F.coalesce(F.col(f"{held}.text"), source)} | counts).drop(held)
