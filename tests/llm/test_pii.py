import datetime
import re

from pyspark.sql import functions as F

from folioflow.llm.pii import _mod97, luhn_sum, permute_pair, permute_text, pseudonymise


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def test_replaces_valid_values_in_their_format(spark):
    rows = [
        (1, "mail ann.lee@x.example.com or +1 (988) 555-2485, card 4111 1111 1111 1111."),
        (2, "card 4111111111111112 bad; 4111111111111111 good; 10.0.0.255 and 10.0.0.256; 2024-02-29 but 2023-02-29"),
        (3, "ann.lee@x.example.com again, ssn 123-45-6789, not 666-45-6789, iban GB82WEST12345698765432 ok GB83WEST12345698765432"),
        (4, None), (5, ""), (6, "no data here " * 2000),
    ]
    df = spark.createDataFrame([(i, t, "f") for i, t in rows], "doc_id long, text string, found string")
    got = {r.doc_id: r for r in pseudonymise(df, "k").collect()}
    assert got[1].found == ["email", "phone", "card"]
    m = re.fullmatch(r"mail (\w{3}\.\w{3})@x\.example\.com or (\+1 \(\d{3}\) \d{3}-\d{4}), card (\d{4} \d{4} \d{4} \d{4})\.", got[1].text)
    assert m and m[1] != "ann.lee" and luhn(m[3].replace(" ", ""))
    assert got[2].found == ["card", "address", "date"]
    assert "4111111111111112 bad" in got[2].text and "10.0.0.256" in got[2].text and "but 2023-02-29" in got[2].text
    d = re.search(r"; (\d{4}-\d\d-\d\d) but", got[2].text)[1]
    assert datetime.date.fromisoformat(d)
    card = re.search(r"bad; (\d{16}) good", got[2].text)[1]
    assert luhn(card) and card == m[3].replace(" ", "")  # linked over documents and forms
    assert m[1] in got[3].text and got[3].found == ["email", "social", "account"]
    assert "not 666-45-6789" in got[3].text and "ok GB83WEST" in got[3].text
    assert got[4].text == got[5].text == "" and got[6].text == rows[5][1] and got[6].found == []
    other = {r.doc_id: r.text for r in pseudonymise(df, "k2").collect()}
    assert other[1] != got[1].text


def test_permutations(spark):
    p = spark.range(189 * 7).select(permute_pair("k", "t", F.floor(F.col("id") / 7), F.col("id") % 7, 189, 7).alias("p")).select("p.l", "p.r").distinct()
    assert p.count() == 189 * 7 and p.agg(F.max("l"), F.max("r")).first() == (188, 6)
    t = spark.range(1000).select(permute_text("k", "t", F.lpad(F.col("id").cast("string"), 3, "0")).alias("x")).distinct()
    assert t.count() == 1000 and t.where("not x rlike '^[0-9]{3}$'").isEmpty()
    assert spark.range(1).select(luhn_sum(F.lit("79927398713")) % 10, _mod97(F.lit("GB82WEST12345698765432"))).first() == (0, 1)


def test_empty(spark):
    assert pseudonymise(spark.createDataFrame([], "doc_id long, text string"), "k").collect() == []


def plain(text, key):
    """The same rules in plain Python: (text, kinds)."""
    import hashlib

    from folioflow.llm.pii import ANY, PATTERNS

    def number(kind, i, other):
        return int(hashlib.sha256(f"{key}|{kind}|{i}|{other}".encode()).hexdigest()[:15], 16)

    def pair(kind, a, b, m, n):
        for i in range(4):
            a = (a + number(kind, 2 * i, b) % m) % m
            b = (b + number(kind, 2 * i + 1, a) % n) % n
        return a, b

    def shifted(t, kind, i, other):
        by, out = hashlib.sha256(f"{key}|{kind}|{i}|{other}".encode()).hexdigest(), ""
        for k, c in enumerate(t):
            n = int(by[k * 2 % 62 :][:2], 16)
            for alphabet in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
                if c in alphabet:
                    c = alphabet[(alphabet.index(c) + n) % len(alphabet)]
                    break
            out += c
        return out

    def letters(kind, t):
        a, b = t[: len(t) // 2], t[len(t) // 2 :]
        for i in range(4):
            a = shifted(a, kind, 2 * i, b)
            b = shifted(b, kind, 2 * i + 1, a)
        return a + b

    def into(form, digits):
        digits = iter(digits)
        return "".join(next(digits) if c.isdigit() else c for c in form)

    def mod97(v):
        return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97

    def email(v):
        local, host = v.split("@")
        return letters("email", local) + "@" + host

    def address(v):
        p = [int(x) for x in v.split(".")]
        if max(p) > 255:
            return None
        a, b = pair("address", p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536)
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"

    def phone(v):
        d = re.sub(r"\D", "", v)[-10:]
        area, rest = int(d[:3]), int(d[3:])
        a, r, m, n = (0, 0, 200, 10**7) if area < 200 else (200, 0, 800, 2 * 10**6) if rest < 2 * 10**6 else (200, 2 * 10**6, 800, 8 * 10**6)
        x, y = pair("phone", area - a, rest - r, m, n)
        return into(v, ("1" if v.startswith("+1") else "") + f"{x + a:03d}{y + r:07d}")

    def account(v):
        if mod97(v) != 1:
            return None
        body = letters("account", v[4:])
        return v[:2] + f"{98 - mod97(v[:2] + '00' + body):02d}" + body

    def card(v):
        d = re.sub(r"\D", "", v)
        if not 13 <= len(d) <= 19 or not luhn(d):
            return None
        body = letters("card", d[:-1])
        return into(v, body + next(c for c in "0123456789" if luhn(body + c)))

    def social(v):
        area, group, serial = int(v[:3]), int(v[4:6]), int(v[7:])
        if not (1 <= area <= 899 and area != 666 and group and serial):
            return None
        a, b = pair("social", area - (2 if area > 666 else 1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999)
        return f"{a + (2 if a >= 665 else 1):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"

    def date(v):
        try:
            day = (datetime.date.fromisoformat(v) - datetime.date(1800, 1, 1)).days
        except ValueError:
            return None
        if not 0 <= day < 146_097:
            return None
        a, b = pair("date", day // 773, day % 773, 189, 773)
        return str(datetime.date(1800, 1, 1) + datetime.timedelta(a * 773 + b))

    rules, kinds, out, at = dict(email=email, address=address, phone=phone, account=account, card=card, social=social, date=date), [], "", 0
    for m in re.finditer(ANY, text or ""):
        new = m[0]
        for kind, rule in rules.items():
            if re.fullmatch(PATTERNS[kind], m[0]) and (made := rule(m[0])) is not None:
                new = made
                kinds.append(kind)
                break
        out, at = out + text[at : m.start()] + new, m.end()
    return out + (text or "")[at:], kinds


def test_brute_force(spark):
    import random

    rng = random.Random(11)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))

    def some():
        body = digits(15)
        card = body + next(c for c in "0123456789" if luhn(body + c))
        return rng.choice(
            [
                f"a{digits(2)}.B-c_{digits(1)}@x{digits(1)}.co.uk", ".".join(str(rng.randint(0, 300)) for _ in range(4)), f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}",
                card, f"{card[:4]}-{card[4:8]}-{card[8:12]}-{card[12:]}", digits(16), f"{digits(3)}-{digits(2)}-{digits(4)}", f"{rng.randint(1790, 2210)}-{rng.randint(1, 13):02d}-{rng.randint(1, 31):02d}",
                "GB82WEST12345698765432", "DE89370400440532013000", "DE89370400440532013001", "word", "12", "@", "é",
            ]
        )

    rows = [(i, rng.choice([" ", ", ", "\n", ""]).join(some() for _ in range(rng.randint(0, 9)))) for i in range(400)] + [(900, None), (901, (some() + " ") * 3000)]
    rows += [rows[3], (None, rows[4][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((str(r.doc_id), r.text, list(r.found)) for r in pseudonymise(df, "k").collect()))
    assert got == sorted((str(i), *plain(t, "k")) for i, t in rows)
