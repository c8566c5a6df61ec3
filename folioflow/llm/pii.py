"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

Candidates are found by pattern and validated (Luhn for card numbers, calendar
for dates, ranges for addresses, the rules of issue for social security numbers,
modulo 97 for bank accounts). A valid value is permuted inside the set of all
values of its format: two halves are added to each other's keyed hash in turn,
modulo the size of each half, so each value has one pseudonym and each pseudonym
one value, and equal values stay equal in all documents. All of it is DataFrame
operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tasks import text_or_empty

ROUNDS = 8

# What each kind looks like, first match wins.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "address": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)",
    "phone": r"\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "card": r"(?<![\d-])(?:\d{4}[ -]?){3}\d{1,7}(?![\d-])",
    "social": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "date": r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Days of one whole turn of the calendar, and the halves it splits into.
FIRST_DAY, DAYS, HALF = "1800-01-01", 146_097, 189


def _number(key: str, kind: str, i: Column, other: Column) -> Column:
    """A keyed hash of a round and the other half, as a number below 2**60."""
    said = F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), other.cast("string"))
    return F.conv(F.substring(F.sha2(said, 256), 1, 15), 16, 10).cast("long")


def permute_pair(key: str, kind: str, a: Column, b: Column, m: int, n: int) -> Column:
    """A permutation of the pairs (a < m, b < n), as a struct of l and r."""
    start = F.struct(a.cast("long").alias("l"), b.cast("long").alias("r"))

    def step(s, i):
        l = F.pmod(s["l"] + F.pmod(_number(key, kind, 2 * i, s["r"]), F.lit(m)), F.lit(m))
        s = F.struct(l.alias("l"), s["r"].alias("r"))
        r = F.pmod(s["r"] + F.pmod(_number(key, kind, 2 * i + 1, s["l"]), F.lit(n)), F.lit(n))
        return F.struct(s["l"].alias("l"), r.alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS // 2 - 1)), start, step)


_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _shifted(text: Column, by: Column) -> Column:
    """Each letter and digit moved within its kind by a part of the hash ``by``."""

    def move(c, i):
        n = F.conv(F.substring(by, (i * 2) % 62 + 1, F.lit(2)), 16, 10).cast("int")
        out = c
        for alphabet in _ALPHABETS:
            at = F.instr(F.lit(alphabet), c)
            out = F.when(at > 0, F.substring(F.lit(alphabet), F.pmod(at - 1 + n, F.lit(len(alphabet))) + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), move), "")


def permute_text(key: str, kind: str, text: Column) -> Column:
    """A permutation of the texts that have letters and digits where this one has."""
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.length(text)).alias("r"))
    say = lambda i, x: F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), x), 256)

    def step(s, i):
        l = _shifted(s["l"], say(2 * i, s["r"]))
        s = F.struct(l.alias("l"), s["r"].alias("r"))
        return F.struct(s["l"].alias("l"), _shifted(s["r"], say(2 * i + 1, s["l"])).alias("r"))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS // 2 - 1)), start, step)
    return F.concat(done["l"], done["r"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def luhn_sum(digits: Column, from_right: int = 0) -> Column:
    """Luhn sum of a text of digits whose last one stands ``from_right`` places
    left of the end."""
    each = F.transform(
        F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""),
        lambda c, i: F.when((i + from_right) % 2 == 1, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)).otherwise(c.cast("int")),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _mod97(account: Column) -> Column:
    """Remainder of a bank account with its first four characters moved to the end
    and letters counted from 10."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def step(a, c):
        n = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        return F.when(n < 10, (a * 10 + n) % 97).otherwise((a * 100 + n) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)


def _into(form: Column, digits: Column) -> Column:
    """``digits`` put where ``form`` has digits, the rest of ``form`` as it is."""
    gaps = F.split(form, r"\d")
    each = F.concat(F.filter(F.split(digits, ""), lambda c: c != ""), F.array(F.lit("")))
    return F.array_join(F.zip_with(gaps, each, lambda g, d: F.concat(g, d)), "")


def _pad(n: Column, size: int) -> Column:
    return F.lpad(n.cast("string"), size, "0")


def _email(key, v):
    local = F.substring_index(v, "@", 1)
    return F.lit(True), F.concat(permute_text(key, "email", local), F.lit("@"), F.substring_index(v, "@", -1))


def _address(key, v):
    part = F.transform(F.split(v, r"\."), lambda x: x.cast("int"))
    at = lambda i: F.element_at(part, i)
    p = permute_pair(key, "address", at(1) * 256 + at(2), at(3) * 256 + at(4), 65536, 65536)
    out = F.concat_ws(".", *((p[h] / d).cast("long") % 256 for h in ("l", "r") for d in (256, 1)))
    return F.forall(part, lambda x: x <= 255), out


def _phone(key, v):
    # Area and exchange from 200 on are in use; a number stays in use, or out of it.
    d = F.substring(_digits(v), -10, 10)
    area, rest = F.substring(d, 1, 3).cast("int"), F.substring(d, 4, 7).cast("int")
    sets = ((area < 200, 0, 0, 200, 10_000_000), (rest < 2_000_000, 200, 0, 800, 2_000_000), (F.lit(True), 200, 2_000_000, 800, 8_000_000))
    p = None
    for fits, a, r, m, n in reversed(sets):
        own = permute_pair(key, "phone", area - a, rest - r, m, n)
        own = F.struct((own["l"] + a).alias("l"), (own["r"] + r).alias("r"))
        p = own if p is None else F.when(fits, own).otherwise(p)
    country = F.when(v.startswith("+1"), "1").otherwise("")
    return F.lit(True), _into(v, F.concat(country, _pad(p["l"], 3), _pad(p["r"], 7)))


def _account(key, v):
    body = permute_text(key, "account", F.substring(v, F.lit(5), F.length(v)))
    country = F.substring(v, 1, 2)
    check = 98 - _mod97(F.concat(country, F.lit("00"), body))
    return _mod97(v) == 1, F.concat(country, _pad(check, 2), body)


def _card(key, v):
    d = _digits(v)
    body = permute_text(key, "card", F.substring(d, F.lit(1), F.length(d) - 1))
    check = F.pmod(10 - luhn_sum(body, 1) % 10, F.lit(10))
    return F.length(d).between(13, 19) & (luhn_sum(d) % 10 == 0), _into(v, F.concat(body, check.cast("string")))


def _social(key, v):
    # Areas 001-665 and 667-899, groups 01-99, serials 0001-9999.
    area, group, serial = (F.substring(v, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    p = permute_pair(key, "social", area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999)
    area = p["l"] + F.when(p["l"] >= 665, 2).otherwise(1)
    return valid, F.concat(_pad(area, 3), F.lit("-"), _pad(F.floor(p["r"] / 9999) + 1, 2), F.lit("-"), _pad(p["r"] % 9999 + 1, 4))


def _date(key, v):
    day = F.datediff(F.try_to_date(v), F.lit(FIRST_DAY).cast("date"))
    p = permute_pair(key, "date", F.floor(day / (DAYS // HALF)), day % (DAYS // HALF), HALF, DAYS // HALF)
    out = F.date_add(F.lit(FIRST_DAY).cast("date"), (p["l"] * (DAYS // HALF) + p["r"]).cast("int"))
    return day.between(0, DAYS - 1), F.date_format(out, "yyyy-MM-dd")


KINDS = {"email": _email, "address": _address, "phone": _phone, "account": _account, "card": _card, "social": _social, "date": _date}


def pseudonym(value: Column, key: str) -> Column:
    """struct(kind, out) for a candidate: its kind and pseudonym, or a null kind and
    the value itself where no kind's rules hold."""
    found = F.struct(F.lit(None).cast("string").alias("kind"), value.alias("out"))
    for kind, rule in reversed(KINDS.items()):
        valid, out = rule(key, value)
        found = F.when(value.rlike(f"^(?:{PATTERNS[kind]})$") & valid, F.struct(F.lit(kind).alias("kind"), out.alias("out"))).otherwise(found)
    return found


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``' id, the text with pseudonyms, and ``found``, the kinds that were
    replaced in order.

    Null texts count as empty; candidates that fail validation stay as they are.
    Texts are whole, of any length. Extra columns are not looked at; an empty table
    gives no rows.
    """
    text = text_or_empty(text_col)
    # Every kind has a digit or an @: texts without them are not searched further.
    some = text.rlike("[0-9@]")
    values = F.when(some, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    made = F.transform(values, lambda v: pseudonym(v, key))
    gaps = F.when(some, F.split(text, ANY, -1)).otherwise(F.array(text))
    rows = docs.select(F.col(id_col), gaps.alias("__gaps"), made.alias("__made"))
    ends = F.concat(F.transform("__made", lambda m: m["out"]), F.array(F.lit("")))
    return rows.select(
        id_col,
        F.array_join(F.zip_with("__gaps", ends, lambda g, m: F.concat(g, m)), "").alias("text"),
        F.filter(F.transform("__made", lambda m: m["kind"]), lambda k: k.isNotNull()).alias("found"),
    )


def pseudonymised(docs: DataFrame, key: str = "folio-demo-key") -> DataFrame:
    """doc_id, n_found, kinds (in order of the text) and the new text's SHA-256."""
    out = pseudonymise(docs, key)
    return out.select(
        "doc_id", F.size("found").cast("long").alias("n_found"), F.array_join("found", ",").alias("kinds"), "text", F.sha2("text", 256).alias("text_sha256")
    )
