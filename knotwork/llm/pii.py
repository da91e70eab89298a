"""Format-preserving pseudonyms for personal data, all in DataFrame expressions.

Candidates are found by one pattern, validated by kind (check sums, ranges, the calendar), and permuted under a key within their format by a Feistel network. A value becomes a list of numbers with a modulus each (digits, letters, octets of an address, two parts of a day number); in each round one half of the list is shifted by a keyed hash of the other half. A number ends where a value of another kind starts, and a run of digits is searched for the cards in it. So equal values keep equal pseudonyms in all documents, different ones stay different, and whoever has the key can turn it back. What fails its validation stays as it is.

Kinds: card numbers (Luhn; the last digit is set anew), IBANs (mod 97; check digits set anew), US social security numbers (valid areas only), telephone numbers (the country code stays), IPv4 addresses, dates from 1900 on in three notations (by their day, so one day in two notations stays one day), and the local part of e-mail addresses (letters stay letters, digits digits).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm.common import table

#: The session's setting that holds the key. Without it a fixed text is the key, which keeps values linked but is no secret.
KEY_SETTING, NO_KEY = "spark.knotwork.pseudonym.key", "no secret"
ROUNDS = 10
#: Days from 1900-01-01 that are permuted: DAY_HIGH * DAY_LOW of them.
DAY_HIGH, DAY_LOW, FIRST_DAY = 250, 292, "1900-01-01"

# Every alternative starts at a boundary and takes a bounded number of characters, so that the search is linear in the text.
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9](?:[A-Za-z0-9\-]{0,62}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
#: Length of a country's IBANs; others count in one piece only.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBANS = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBAN_LENGTHS.items())
IBAN = rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:(?:{_IBANS})|[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}})(?![A-Za-z0-9])"
IP = r"(?<![A-Za-z0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![A-Za-z0-9]|\.[0-9])"
DATE = r"(?<![A-Za-z0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![A-Za-z0-9]|[\-/.][0-9])"
SSN = r"(?<![A-Za-z0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9]|-[0-9])"
_LOCAL = r"\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}"
# A number goes on behind a separator only where no value of another kind starts.
_OTHER = rf"{EMAIL}|{IP}|{DATE}|{SSN}|(?:{_LOCAL})(?![A-Za-z0-9]|-[0-9])"
_CARD_GROUPS = r"[0-9]{4}[ \-][0-9]{4}[ \-][0-9]{4}[ \-][0-9]{1,4}(?![0-9])|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{4,5}(?![0-9])"
_DIGIT = rf"(?:(?:[ .\-](?=[0-9]{{2}})(?!{_OTHER}|{_CARD_GROUPS}))?[0-9])"
# The longest number of 7 to 14 digits behind the code; behind +1 ten, if there is a number of ten.
_CODED = "|".join([rf"[ .\-](?=[0-9]{{2}})[0-9]{_DIGIT}{{6,13}}", *(rf"[ .\-]?\([0-9]{{{k}}}\)[ .\-]?(?=[0-9]{{2}})[0-9]{_DIGIT}{{{6 - k},{13 - k}}}" for k in (1, 2, 3, 4))])
PHONE = rf"(?<![A-Za-z0-9])(?:\+1[ .\-]?(?:\([0-9]{{3}}\)|[0-9]{{3}})[ .\-]?[0-9]{{3}}[ .\-]?[0-9]{{4}}(?![A-Za-z0-9]|-[0-9])|\+[0-9]{{1,3}}(?:{_CODED})|\+(?=[0-9]{{4}})[0-9]{_DIGIT}{{6,13}}|{_LOCAL})(?![A-Za-z0-9]|-[0-9])"
#: A run of digits in which `pieces` looks for cards.
CARD = rf"(?<![A-Za-z0-9])[0-9](?:(?:[ \-](?!{_OTHER}))?[0-9]){{12,400}}(?![A-Za-z0-9])"
#: How cards are mostly written.
CARD_SHAPE = r"^(?:[0-9]{13,19}|(?:[0-9]{4}[ \-]){3}[0-9]{1,4}|(?:[0-9]{4}[ \-]){4}[0-9]{1,3}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{4,5})$"
KINDS = {"email": EMAIL, "iban": IBAN, "ip": IP, "date": DATE, "ssn": SSN, "phone": PHONE, "card": CARD}
ANY = "|".join(KINDS.values())


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def feistel(values: Column, moduli: Column, kind: str, key: str, back: bool = False) -> Column:
    """A keyed permutation of lists whose i-th number is below the i-th modulus; `back` inverts it."""
    half = F.floor(F.size(values) / 2).cast("int")

    def turn(now: Column, i: Column) -> Column:
        first = i % 2 == 0  # the first half is shifted by the second
        other = F.when(first, F.slice(now, half + 1, F.size(now) - half)).otherwise(F.slice(now, F.lit(1), half))
        said = F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), F.size(now).cast("string"), F.concat_ws(",", F.transform(other, lambda x: x.cast("string"))))
        return let(F.concat(F.sha2(F.concat(said, F.lit("#0")), 256), F.sha2(F.concat(said, F.lit("#1")), 256)), lambda stream: F.transform(now, lambda x, j: shifted(x, j, stream, first)))

    def shifted(x: Column, j: Column, stream: Column, first: Column) -> Column:
        by = F.conv(F.substring(stream, (j % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        m = F.element_at(moduli, j + 1)
        moved = F.pmod(x - by % m, m) if back else (x + by) % m
        return F.when((j < half) == first, moved).otherwise(x)

    order = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(order, values, turn)


def chars(s: Column) -> Column:
    return F.split(s, "")


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def alnum_feistel(s: Column, kind: str, key: str, back: bool = False) -> Column:
    """Letters stay letters of their case, digits digits, all else itself."""
    list_ = lambda f: F.transform(chars(s), f)
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).when(c.between("a", "z"), F.ascii(c) - 97).when(c.between("A", "Z"), F.ascii(c) - 65).otherwise(0)
    modulus = lambda c: F.when(c.between("0", "9"), 10).when(c.between("a", "z") | c.between("A", "Z"), 26).otherwise(1)
    base = lambda c: F.when(c.between("0", "9"), 48).when(c.between("a", "z"), 97).when(c.between("A", "Z"), 65).otherwise(F.ascii(c))
    return F.when(F.length(s) == 0, s).otherwise(F.concat_ws("", F.zip_with(feistel(list_(value), list_(modulus), kind, key, back), list_(base), lambda v, b: F.char(v + b))))


def filled(template: Column, digits: Column) -> Column:
    """The template with its digits replaced in order."""
    at = lambda i: F.length(digits_of(F.substring(template, F.lit(1), i + 1)))
    return F.concat_ws("", F.transform(chars(template), lambda c, i: F.when(c.between("0", "9"), F.substring(digits, at(i), F.lit(1))).otherwise(c)))


def luhn_sum(digits: Column) -> Column:
    """The sum of a number's digits, every second from the right doubled (and its digits added)."""
    each = F.transform(chars(F.reverse(digits)), lambda c, i: let((F.ascii(c) - 48) * (1 + i % 2), lambda d: d - F.when(d > 9, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d)


def card(m: Column, key: str, back: bool = False) -> Column:
    def make(d: Column) -> Column:
        body = alnum_feistel(F.substring(d, F.lit(1), F.length(d) - 1), "card", key, back)
        return let(body, lambda b: F.concat(b, F.pmod(-luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))

    return let(digits_of(m), lambda d: F.when(F.length(d).between(13, 19) & luhn_valid(d), filled(m, make(d))).otherwise(m))


def luhn_valid(d: Column) -> Column:
    return (luhn_sum(d) % 10 == 0) & ~d.rlike("^0+$")


def pieces(m: Column) -> Column:
    """A run of digits cut into its cards and what is between; any other candidate as it is.

    A card has 13 to 19 digits from one separator to another. Of those that overlap the one of a usual shape counts, then the longest, then the first."""
    groups = F.split(m, "[ \\-]")
    # (start, end) of each group, counted from 1, the end not in it.
    spans = F.aggregate(groups, F.expr("cast(array() as array<struct<s:int,e:int>>)"), lambda a, g: F.concat(a, F.array(let(F.coalesce(F.get(a, F.size(a) - 1)["e"] + 1, F.lit(1)), lambda s: F.struct(s.alias("s"), (s + F.length(g)).alias("e"))))))

    def windows(at: Column) -> Column:
        row = lambda i: F.transform(F.slice(at, i + 1, F.lit(19)), lambda last: judged(F.element_at(at, i + 1)["s"], last["e"]))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(at) - 1), row))

    def judged(s: Column, e: Column) -> Column:
        text = F.substring(m, s, e - s)
        shaped = F.when(text.rlike(CARD_SHAPE), 0).otherwise(1)
        digits = digits_of(text)
        good = F.when(F.length(digits).between(13, 19), luhn_valid(digits)).otherwise(False)
        return F.struct(shaped.alias("o"), (-F.length(digits)).alias("n"), s.alias("s"), e.alias("e"), good.alias("good"))

    none = F.expr("cast(array() as array<struct<s:int,e:int>>)")
    apart = lambda acc, w: ~F.exists(acc, lambda x: (x["s"] < w["e"]) & (w["s"] < x["e"]))
    chosen = lambda ws: F.aggregate(F.array_sort(F.filter(ws, lambda w: w["good"])), none, lambda acc, w: F.when(apart(acc, w), F.concat(acc, F.array(F.struct(w["s"].alias("s"), w["e"].alias("e"))))).otherwise(acc))

    def cut(cards: Column) -> Column:
        ends = F.concat(F.array(F.lit(1)), F.flatten(F.transform(F.array_sort(cards), lambda x: F.array(x["s"], x["e"]))), F.array(F.length(m) + 1))
        return let(ends, lambda p: F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.substring(m, F.element_at(p, i), F.element_at(p, i + 1) - F.element_at(p, i))))

    run = m.rlike("^[0-9](?:[ \\-]?[0-9]){12,400}$")
    return F.when(run, let(spans, lambda at: let(windows(at), lambda ws: let(chosen(ws), cut)))).otherwise(F.array(m))


def ssn_valid(d: Column) -> Column:
    return ~F.substring(d, 1, 3).isin("000", "666") & (F.substring(d, 1, 1) != "9") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")


def ssn(m: Column, key: str, back: bool = False) -> Column:
    once = lambda d: alnum_feistel(d, "ssn", key, back)
    # The permutation is walked on until it meets a valid number; nine in ten are.
    walk = lambda d: F.aggregate(F.sequence(F.lit(1), F.lit(24)), once(d), lambda a, _: F.when(ssn_valid(a), a).otherwise(once(a)))
    return let(digits_of(m), lambda d: F.when(ssn_valid(d), filled(m, walk(d))).otherwise(m))


def phone(m: Column, key: str, back: bool = False) -> Column:
    """Seven digits at least besides the country code, which are the first one to three after a plus sign."""
    code = F.when(m.startswith("+"), F.regexp_extract(m, r"^\+([0-9]{1,3})(?![0-9])", 1)).otherwise("")
    make = lambda d, c: F.concat(c, alnum_feistel(F.substring(d, F.length(c) + 1, F.length(d)), "phone", key, back))
    return let(digits_of(m), lambda d: let(code, lambda c: F.when((F.length(d) - F.length(c)).between(7, 14), filled(m, make(d, c))).otherwise(m)))


def ip(m: Column, key: str, back: bool = False) -> Column:
    parts = lambda s: F.transform(F.split(s, r"\."), lambda p: p.cast("int"))
    make = lambda p: F.concat_ws(".", F.transform(feistel(p, F.transform(p, lambda _: F.lit(256)), "ip", key, back), lambda x: x.cast("string")))
    return let(parts(m), lambda p: F.when(F.forall(p, lambda x: x < 256), make(p)).otherwise(m))


def iban_rest(s: Column) -> Column:
    """The number that the letters and digits of s spell, modulo 97."""
    step = lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(chars(s), F.lit(0), step)


def iban(m: Column, key: str, back: bool = False) -> Column:
    def make(s: Column) -> Column:
        land = F.substring(s, 1, 2)
        body = alnum_feistel(F.substring(s, F.lit(5), F.length(s)), "iban", key, back)
        check = lambda b: F.lpad((98 - iban_rest(F.concat(b, land, F.lit("00")))).cast("string"), 2, "0")
        return let(body, lambda b: F.concat(land, check(b), b))

    spaced = lambda s: F.when(m.contains(" "), F.trim(F.regexp_replace(s, "(.{4})", "$1 "))).otherwise(s)
    plain = F.replace(m, F.lit(" "), F.lit(""))
    return let(plain, lambda s: F.when(F.length(s).between(15, 34) & (iban_rest(F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))) == 1), spaced(make(s))).otherwise(m))


def date(m: Column, key: str, back: bool = False) -> Column:
    """Day and month in a slashed date are taken as day/month, and as month/day only where that is no date. So the pseudonym of a month/day date may read as day/month when it is turned back."""
    first = F.lit(FIRST_DAY).cast("date")
    forms = ["yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd.MM.yyyy"]
    looks = lambda f: m.contains(f[4] if f[0] == "y" else f[2])

    def make(day: Column, f: str) -> Column:
        n = F.datediff(day, first)
        pair = feistel(F.array(F.floor(n / DAY_LOW).cast("int"), (n % DAY_LOW).cast("int")), F.array(F.lit(DAY_HIGH), F.lit(DAY_LOW)), "date", key, back)
        return let(let(pair, lambda p: F.date_add(first, F.element_at(p, 1) * DAY_LOW + F.element_at(p, 2))), lambda d: written(d, f))

    def written(d: Column, f: str) -> Column:
        part = {"y": F.year(d), "M": F.month(d), "d": F.day(d)}
        return F.concat(*(F.lpad(part[x[0]].cast("string"), len(x), "0") if x[0] in part else F.lit(x) for x in re.findall(r"y+|M+|d+|\W", f)))

    def tried(f: str, else_: Column) -> Column:
        day = F.when(looks(f), F.try_to_timestamp(m, F.lit(f)).cast("date"))
        good = lambda d: d.isNotNull() & F.datediff(d, first).between(0, DAY_HIGH * DAY_LOW - 1)
        return let(day, lambda d: F.when(good(d), make(d, f)).otherwise(else_))

    out = F.lit(None).cast("string")
    for form in reversed(forms):
        out = tried(form, out)
    return F.coalesce(out, m)


def email(m: Column, key: str, back: bool = False) -> Column:
    return F.concat(alnum_feistel(F.substring_index(m, "@", 1), "email", key, back), F.lit("@"), F.substring_index(m, "@", -1))


MAKERS = {"email": email, "iban": iban, "ip": ip, "date": date, "ssn": ssn, "phone": phone, "card": card}


def pseudonym(m: Column, key: str, back: bool = False) -> Column:
    """The pseudonym of one candidate, or the candidate where it is no valid value of its kind."""
    out = m
    for kind, pattern in reversed(KINDS.items()):
        out = F.when(m.rlike(f"^(?:{pattern})$"), MAKERS[kind](m, key, back)).otherwise(out)
    return out


def key_of(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, None) or NO_KEY


def pseudonymised(df: DataFrame, key: str, text: str = "text", to: str = "text", found: str | None = None, back: bool = False) -> DataFrame:
    """df with `to`, its text with all valid personal values under pseudonyms, and with `found`, how many were replaced, if named.

    Null text stays null and counts none. Whole texts, in one pass without a shuffle; texts without a digit or @ are only looked at. Repeated values have one pseudonym everywhere. Other columns stay as they are."""
    taken = set(df.columns) - {to}
    names = [next(n for n in (f"__{x}{'_' * i}" for i in range(99)) if n not in taken) for x in ("matches", "new")]
    likely = F.col(text).rlike("[0-9@]")
    work = df.withColumn(names[0], F.when(likely, F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), pieces)))
    work = work.withColumn(names[1], F.when(F.size(names[0]) > 0, F.transform(names[0], lambda ps: F.transform(ps, lambda m: pseudonym(m, key, back)))))
    if found:
        work = work.withColumn(found, F.when(F.col(names[1]).isNotNull(), F.size(F.filter(F.zip_with(F.flatten(names[0]), F.flatten(names[1]), lambda a, b: a != b), lambda x: x))).otherwise(0).cast("long"))
    values = F.transform(names[1], lambda ps: F.concat_ws("", ps))
    whole = F.concat_ws("", F.zip_with(F.split(text, ANY, -1), F.concat(values, F.array(F.lit(""))), lambda a, b: F.concat(a, b)))
    return work.withColumn(to, F.when(F.col(names[1]).isNotNull(), whole).otherwise(F.col(text))).drop(*names)


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymised(docs, key_of(spark), found="n_replaced").select("doc_id", "n_replaced", F.length("text").cast("long").alias("n_chars"), "text")
