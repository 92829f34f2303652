"""Operator 3: format-preserving Feistel pseudonyms for personal data (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aptaforge.llm.common import let

ROUNDS = 8
DIGITS, HEX, LETTERS, BASE32 = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Days of the Gregorian cycle of 400 years from 0001-01-01 on: 146097 = 189 * 773. The last one, 9601 to 9999, has 145731 = 93 * 1567.
CYCLE, LAST_CYCLE, CYCLES = (189, 773), (93, 1567), 24
#: Valid social security numbers: areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999.
SSN_SPACE = (898, 99 * 9999)

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
KEY = r"(?<![A-Za-z0-9])AKIA[A-Z2-7]{16}(?![A-Za-z0-9])"
IP = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
ISO_DATE = r"(?<!\d)\d{4}-\d{2}-\d{2}(?!\d)"
US_DATE = r"(?<!\d)\d{2}/\d{2}/\d{4}(?!\d)"
SSN = r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)"
PHONE = r"(?:\+1[ .-]?)?(?:\(\d{3}\) ?|(?<!\d)\d{3}[.-])\d{3}[.-]\d{4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)"
#: What ends a run of digit groups: another kind that starts there, or a group too long for a card.
NOT_CARD = rf"{EMAIL}|{IP}|{ISO_DATE}|{US_DATE}|{SSN}|{PHONE}|\d{{20}}|(?=\d*[a-f])[0-9a-f]{{16,64}}(?![A-Za-z0-9])"
CARD = rf"(?<!\d)(?!\d{{20}})\d(?:(?:[ -](?!{NOT_CARD}))?\d){{12,}}(?!\d)"
#: Bare digits are no key.
HEX_KEY = r"(?<![A-Za-z0-9])(?=[0-9]*[a-f])[0-9a-f]{16,64}(?![A-Za-z0-9])"
#: In order: the first that fits at a place wins.
KINDS = {"email": EMAIL, "key": KEY, "ip": IP, "iso_date": ISO_DATE, "us_date": US_DATE, "ssn": SSN, "phone": PHONE, "card": CARD, "hex": HEX_KEY}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())


def permute_pair(a: Column, b: Column, m: Column, n: Column, tweak: Column, key: str) -> Column:
    """A keyed permutation of the pairs (a < m, b < n): alternating Feistel rounds by SHA-256. A struct of a and b."""

    def round_(state: Column, r: Column) -> Column:
        even = r % 2 == 0
        other = F.when(even, state["b"]).otherwise(state["a"])
        text = F.concat_ws("|", F.lit(key), tweak, r.cast("string"), m.cast("string"), n.cast("string"), other.cast("string"))
        f = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")
        return F.when(even, F.struct(((state["a"] + f % m) % m).alias("a"), state["b"].alias("b"))).otherwise(
            F.struct(state["a"].alias("a"), ((state["b"] + f % n) % n).alias("b"))
        )

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, round_)


def permute_text(text: Column, alphabet: str, tweak: Column, key: str) -> Column:
    """A keyed permutation of the strings of the same length over ``alphabet``, in chunks of two halves below 2 ** 60."""
    radix = len(alphabet)
    half = 1
    while radix ** (half + 1) < 1 << 60:
        half += 1

    def number(s: Column) -> Column:
        if radix == 10:
            return F.coalesce(s.try_cast("long"), F.lit(0))
        chars = F.filter(F.split(s, ""), lambda c: c != "")
        return F.aggregate(chars, F.lit(0).cast("long"), lambda acc, c: acc * radix + F.call_function("locate", c, F.lit(alphabet)) - 1)

    def power(n: Column) -> Column:
        return F.pow(F.lit(float(radix)), n).cast("long")

    def string(x: Column, n: Column) -> Column:
        places = F.when(n > 0, F.sequence(n - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        return F.array_join(F.transform(places, lambda k: F.substring(F.lit(alphabet), (exact_div(x, power(k)) % radix + 1).cast("int"), F.lit(1))), "")

    def chunk(part: Column) -> Column:
        n = F.length(part)
        left = F.floor(n / 2).cast("int")

        def mixed(sizes: Column) -> Column:
            pair = permute_pair(number(F.substring(part, F.lit(1), sizes["l"])), number(F.substring(part, sizes["l"] + 1, sizes["r"])), power(sizes["l"]), power(sizes["r"]), tweak, key)
            return let(pair, lambda p: F.concat(string(p["a"], sizes["l"]), string(p["b"], sizes["r"])))

        return let(F.struct(left.alias("l"), (n - left).alias("r")), mixed)

    parts = F.filter(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{2 * half}}}"), F.lit(0)), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: chunk(p)), "")


def exact_div(a: Column, b: Column) -> Column:
    """Integer division of non-negative longs."""
    return F.call_function("div", a, b)


def only(text: Column, keep: str) -> Column:
    return F.regexp_replace(text, f"[^{keep}]", "")


def refill(text: Column, fresh: Column, kind: str) -> Column:
    """``text`` with its characters of class ``kind`` replaced, in order, by those of ``fresh``."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")

    def put(cs: Column, new: Column) -> Column:
        before = lambda i: F.length(only(F.array_join(F.slice(cs, F.lit(1), i + 1), ""), kind))
        return F.array_join(F.transform(cs, lambda c, i: F.when(c.rlike(f"^[{kind}]$"), F.substring(new, before(i), F.lit(1))).otherwise(c)), "")

    return let(chars, lambda cs: let(fresh, lambda new: put(cs, new)))


def luhn_sum(digits: Column, doubled_last: bool) -> Column:
    """Luhn sum of ``digits``; whether the last digit is among those doubled."""
    cs = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == (0 if doubled_last else 1), twice).otherwise(d)

    return F.aggregate(F.transform(cs, value), F.lit(0), lambda acc, x: acc + x)


def card_number(token: Column, digits: Column, key: str) -> Column:
    """All digits but the last are permuted, and the last is set anew."""
    head = F.substring(digits, F.lit(1), F.length(digits) - 1)
    fresh = let(permute_text(head, DIGITS, F.lit("card"), key), lambda h: F.concat(h, F.pmod(-luhn_sum(h, True), F.lit(10)).cast("string")))
    return refill(token, fresh, "0-9")


def card_pseudonym(token: Column, key: str) -> Column:
    """Numbers of 13 to 19 digits with a right check digit within a run of digit groups, longest first, then leftmost.

    A number is whole groups. In runs of over 19 digits, which may be tables of small numbers, its groups
    have four digits or more, but for the last.
    """

    def run(parts: Column, total: Column) -> Column:
        def at(i: Column) -> Column:
            def cut(k: Column) -> Column:
                piece = F.slice(parts, i, k)
                digits = only(F.array_join(piece, ""), "0-9")
                shaped = (total <= 19) | F.forall(F.slice(piece, F.lit(1), k - 1), lambda p: F.length(only(p, "0-9")) >= 4)
                return F.struct((-F.length(digits)).alias("size"), i.alias("i"), k.alias("k"), digits.alias("digits"), shaped.alias("shaped"))

            return F.transform(F.sequence(F.lit(1), F.least(F.lit(19), F.size(parts) - i + 1)), cut)

        cuts = F.flatten(F.transform(F.sequence(F.lit(1), F.size(parts)), at))
        cuts = F.filter(cuts, lambda c: c["size"].between(-19, -13) & c["shaped"] & (luhn_sum(c["digits"], False) % 10 == 0))

        def take(taken: Column, c: Column) -> Column:
            apart = F.forall(taken, lambda t: (c["i"] >= t["i"] + t["k"]) | (t["i"] >= c["i"] + c["k"]))
            return F.when(apart, F.concat(taken, F.array(c))).otherwise(taken)

        kind = "array<struct<size:int,i:int,k:int,digits:string,shaped:boolean>>"
        chosen = F.aggregate(F.array_sort(cuts).cast(kind), F.array().cast(kind), take)

        def rebuilt(taken: Column) -> Column:
            def part(p: Column, i: Column) -> Column:
                inside = F.get(F.filter(taken, lambda t: (i + 1 >= t["i"]) & (i + 1 < t["i"] + t["k"])), F.lit(0))
                number = let(inside, lambda t: card_number(F.array_join(F.slice(parts, t["i"], t["k"]), ""), t["digits"], key))
                return F.when(inside.isNull(), p).when(inside["i"] == i + 1, number).otherwise("")

            return F.when(F.size(taken) == 0, token).otherwise(F.array_join(F.transform(parts, part), ""))

        return let(chosen, rebuilt)

    return let(F.regexp_extract_all(token, F.lit(r"\d+[ -]?"), F.lit(0)), lambda parts: run(parts, F.length(only(token, "0-9"))))


def ip_pseudonym(token: Column, key: str) -> Column:
    octets = F.transform(F.split(token, r"\."), lambda o: o.cast("long"))

    def build(o: Column) -> Column:
        pair = permute_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), F.lit("ip"), key)
        text = let(pair, lambda p: F.concat_ws(".", *[x.cast("string") for x in (exact_div(p["a"], F.lit(256)), p["a"] % 256, exact_div(p["b"], F.lit(256)), p["b"] % 256)]))
        return F.when(F.exists(o, lambda x: x > 255), token).otherwise(text)

    return let(octets, build)


def date_pseudonym(token: Column, form: str, key: str) -> Column:
    """Valid dates of the years 1 to 9999 move within their cycle of 400 years, so a date may move by centuries."""
    days, first = F.unix_date(F.try_to_timestamp(token, F.lit(form)).cast("date")), -719162

    def build(d: Column) -> Column:
        cycle = exact_div((d - first).cast("long"), F.lit(CYCLE[0] * CYCLE[1]))
        at = (d - first).cast("long") - cycle * (CYCLE[0] * CYCLE[1])
        m, n = (F.when(cycle < CYCLES, x).otherwise(y).cast("long") for x, y in zip(CYCLE, LAST_CYCLE, strict=True))
        pair = permute_pair(exact_div(at, n), at % n, m, n, F.lit("date"), key)
        fresh = let(pair, lambda p: (d - at + p["a"] * n + p["b"]).cast("int"))
        return F.when(d.isNull(), token).otherwise(F.date_format(F.date_from_unix_date(fresh), form))

    return let(days, build)


def ssn_pseudonym(token: Column, key: str) -> Column:
    area, group, serial = (F.substring(token, *x).cast("long") for x in ((1, 3), (5, 2), (8, 4)))
    good = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    pair = permute_pair(F.when(area > 666, area - 2).otherwise(area - 1), (group - 1) * 9999 + serial - 1, F.lit(SSN_SPACE[0]), F.lit(SSN_SPACE[1]), F.lit("ssn"), key)
    text = let(pair, lambda p: F.concat_ws("-", F.lpad((F.when(p["a"] > 664, p["a"] + 2).otherwise(p["a"] + 1)).cast("string"), 3, "0"), F.lpad((exact_div(p["b"], F.lit(9999)) + 1).cast("string"), 2, "0"), F.lpad((p["b"] % 9999 + 1).cast("string"), 4, "0")))
    return F.when(good, text).otherwise(token)


def email_pseudonym(token: Column, key: str) -> Column:
    """Letters (as lower case) and digits of the local part are permuted, each in their places; the domain stays."""

    def build(local: Column) -> Column:
        letters, digits = F.lower(only(local, "A-Za-z")), only(local, "0-9")
        fresh = refill(local, permute_text(letters, LETTERS, F.lit("email"), key), "A-Za-z")
        fresh = let(fresh, lambda x: refill(x, permute_text(digits, DIGITS, F.concat(F.lit("email|"), letters), key), "0-9"))
        return F.concat(fresh, F.regexp_extract(token, "@.*$", 0))

    return let(F.regexp_extract(token, "^[^@]*", 0), build)


def kind_of(token: Column) -> Column:
    """Which of KINDS a match is."""
    out = F.when(token.contains("@"), "email").when(token.startswith("AKIA"), "key")
    for name, shape in (
        ("ip", r"^\d+\.\d+\.\d+\.\d+$"), ("iso_date", r"^\d{4}-\d{2}-\d{2}$"), ("us_date", r"^\d{2}/\d{2}/\d{4}$"), ("ssn", r"^\d{3}-\d{2}-\d{4}$"),
        ("phone", f"^(?:{PHONE})$"), ("card", r"^(?!\d{20})\d(?:[ -]?\d){12,}$"),
    ):
        out = out.when(token.rlike(shape), name)
    return out.otherwise("hex")


def pseudonym(token: Column, kind: Column, key: str) -> Column:
    return (
        F.when(kind == "email", email_pseudonym(token, key))
        .when(kind == "key", F.concat(F.lit("AKIA"), permute_text(F.substring(token, 5, 16), BASE32, F.lit("key"), key)))
        .when(kind == "ip", ip_pseudonym(token, key))
        .when(kind == "iso_date", date_pseudonym(token, "yyyy-MM-dd", key))
        .when(kind == "us_date", date_pseudonym(token, "MM/dd/yyyy", key))
        .when(kind == "ssn", ssn_pseudonym(token, key))
        .when(kind == "phone", refill(token, phone_digits(token, key), "0-9"))
        .when(kind == "card", card_pseudonym(token, key))
        .otherwise(permute_text(token, HEX, F.lit("hex"), key))
    )


def phone_digits(token: Column, key: str) -> Column:
    """The digits of a telephone number, its country code in place.

    North American numbers (ten digits, or one more before them that is 1) are validated: area and exchange that both begin with 2 to 9 are
    permuted among such numbers. Others of that shape are permuted among their like (areas below 200; exchanges below 200 in
    other areas), so that no invalid number becomes a valid one. Of other countries' numbers the last ten digits are permuted.
    """

    def north_american(d: Column) -> Column:
        own = F.substring(d, -10, 10)
        area, exchange, line = (F.substring(own, *x).cast("long") for x in ((1, 3), (4, 3), (7, 4)))
        low, few = area < 200, exchange < 200
        a, m = F.when(low, area).otherwise(area - 200), F.when(low, F.lit(200)).otherwise(F.lit(800))
        base = F.when(low | few, F.lit(0)).otherwise(F.lit(200))
        n = F.when(low, F.lit(1000)).when(few, F.lit(200)).otherwise(F.lit(800)) * 10_000
        pair = permute_pair(a, (exchange - base) * 10_000 + line, m.cast("long"), n.cast("long"), F.lit("phone"), key)
        text = let(pair, lambda p: F.concat(F.lpad((p["a"] + F.when(low, 0).otherwise(200)).cast("string"), 3, "0"), F.lpad((p["b"] + base * 10_000).cast("string"), 7, "0")))
        return F.concat(F.substring(d, F.lit(1), F.length(d) - 10), text)

    def build(d: Column) -> Column:
        here = (F.length(d) == 10) & ~token.startswith("+") | (F.length(d) == 11) & d.startswith("1")
        other = F.concat(F.substring(d, F.lit(1), F.greatest(F.length(d) - 10, F.lit(0))), permute_text(F.substring(d, F.greatest(F.length(d) - 9, F.lit(1)), F.lit(10)), DIGITS, F.lit("phone"), key))
        return F.when(here, north_american(d)).otherwise(other)

    return let(only(token, "0-9"), build)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced, and ``pii``, an array of (kind, token, pseudonym).

    Texts are cut at the matches of one pattern; numbers and dates are validated (check digit, octets,
    calendar, number ranges), and each valid one is permuted, under ``key``, among the values
    of its format by a Feistel network. The same value gets the same pseudonym in every document, whatever its
    separators; different values of a format never share one. Invalid ones stay. Null text stays
    null, with an empty array; empty texts and repeated rows are like any other; an empty table stays empty; extra columns pass through;
    a column named ``pii`` is replaced. Nothing is shuffled.

    The key is a literal of the plan, marked by ``pseudonym-key:``; set spark.sql.redaction.string.regex to ``pseudonym-key:[^|,)]*`` for it to
    be left out of plans, the UI and event logs.
    """
    key = f"pseudonym-key:{key}"
    text = F.col(text_col)
    found = F.when(F.coalesce(text.rlike(r"\d|@|[0-9a-f]{16}|AKIA"), F.lit(False)), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))

    def one(token: Column) -> Column:
        return let(kind_of(token), lambda kind: F.struct(kind.alias("kind"), token.alias("token"), pseudonym(token, kind, key).alias("pseudonym")))

    out = docs.withColumn("pii", F.transform(found, one))
    gaps = F.split(text, ANY, -1)
    joined = F.array_join(F.flatten(F.zip_with(gaps, F.col("pii"), lambda g, p: F.array(g, F.coalesce(p["pseudonym"], F.lit(""))))), "")
    return out.withColumn(text_col, F.when(F.size("pii") > 0, joined).otherwise(text))
