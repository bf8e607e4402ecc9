"""Format-preserving Feistel pseudonyms for personal data, in DataFrame operations only.

Candidates come from one regular expression; a candidate that fails its check (Luhn,
IBAN remainder, calendar, address range, number areas that are never issued) stays as it
is. The rest is written as a vector of numbers with a radix each, permuted by a keyed
Feistel network over that vector, and written back in the same format with its check
digits made anew. Equal values get equal pseudonyms in all documents, and different
values of one kind get different ones: what isn't permuted stays in its place, so values
that differ there differ still. All patterns are bounded, and none looks at a long word
again from each of its characters.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rounds of the network; even, so that both halves end where they began.
ROUNDS = 8
_L, _R = "(?<![\\p{L}\\p{N}_])", "(?![\\p{L}\\p{N}_])"
#: A part of a host's name; there are 127 at most.
_LABEL = "[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
#: Characters of an IBAN -> its countries.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
# of a country that isn't listed: as long as it goes
_IBAN = "|".join(
    f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{length // 4 - 1}}}" + (f" ?[A-Z0-9]{{{length % 4}}}" if length % 4 else "") + _R
    for length, countries in IBAN_LENGTHS.items()
) + "|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _R
#: The country code of a phone number: what stands before a sign, or by the plan of codes where none follows.
_CODE = "^(?:\\+[0-9]{1,3}(?![0-9])|\\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}))?"
#: name -> pattern, in order of precedence at one place.
PATTERNS = {
    "email": "(?<![\\p{L}\\p{N}])[\\p{L}\\p{N}][\\p{L}\\p{N}._%+-]{0,63}+@" + _LABEL + "(?:\\." + _LABEL + "){1,126}",
    "secret": "(?:token|secret|password|passwd|api[_-]?key|key)\\s{0,3}[=:]\\s{0,3}[\"']?[0-9a-f]{32,128}(?![0-9A-Za-z])",
    "iban": _L + "(?:" + _IBAN + ")",
    "phone": "\\+[0-9]{1,3}[ .-]?\\([0-9]{2,4}\\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{4}" + _R
    + "|\\+[0-9]{1,3}(?:[ .-][0-9]{2,6}){2,5}" + _R
    + "|(?<![\\p{L}\\p{N}_+])\\+[0-9]{1,3}[ -](?:[0-9]{2,5}[ -])?[0-9]{6,10}" + _R
    + "|(?<![\\p{L}\\p{N}_+])\\+[1-9][0-9]{7,14}(?![\\p{L}\\p{N}_]|\\.[0-9])"
    + "|\\([0-9]{3}\\) ?[0-9]{3}-[0-9]{4}" + _R
    + "|(?<![\\p{L}\\p{N}_.-])[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}(?![\\p{L}\\p{N}_-]|\\.[0-9])",
    "date": "(?<![\\p{L}\\p{N}_./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\\.[0-9]{2}\\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4})(?:(?=T[0-9])|(?![0-9\\p{L}_/-]|\\.[0-9]))",
    "ssn": "(?<![\\p{L}\\p{N}_.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\\p{L}\\p{N}_-]|\\.[0-9])",
    "ip": "(?<![\\p{L}\\p{N}_]|[0-9]\\.)(?:[0-9]{1,3}\\.){3}[0-9]{1,3}(?![\\p{L}\\p{N}_]|\\.[0-9])",
    "card": _L + "(?:[0-9]{4}([ -])[0-9]{4}\\1[0-9]{4}\\1[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})" + _R,
}
KINDS = tuple(PATTERNS)
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def _range(low: int, high: int, upper: bool) -> str:
    """The letters between two code points that are upper case, or not."""
    return "".join(c for c in map(chr, range(low, high + 1)) if c.isalpha() and c.isupper() == upper)


#: Letters that may take each other's place: digits, ASCII, and by case Latin, Greek and Cyrillic ones beyond it.
ALPHABETS = [_DIGIT, _UPPER, _LOWER] + [_range(low, high, upper) for low, high in ((0xC0, 0x17F), (0x386, 0x3CE), (0x400, 0x45F)) for upper in (True, False)]
#: Dates are permuted among DAYS = 256 x 286 days from FIRST_DAY on (to June 2100).
FIRST_DAY, YEARS, DAYS = "1900-01-01", 256, 286


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def permute(values: Column, radices: Column, tweak: Column, key: str) -> Column:
    """A keyed permutation of vectors whose i-th number is below the i-th radix.

    Feistel network: in each round the halves change places after the first has had a
    hash of the second added, number by number, modulo its radices.
    """
    half = F.floor(F.size(values) / 2).cast("int")
    rest = F.size(values) - half
    start = F.struct(
        F.slice(values, F.lit(1), half).alias("a"),
        F.slice(values, half + 1, rest).alias("b"),
        F.slice(radices, F.lit(1), half).alias("ra"),
        F.slice(radices, half + 1, rest).alias("rb"),
    )

    def one_round(s: Column, r: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, r.cast("string"), F.array_join(s["b"].cast("array<string>"), ",")), 512)

        def shifted(h: Column) -> Column:
            return F.transform(
                s["a"],
                lambda x, i: F.pmod(x + F.conv(F.substr(h, (i % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int") + F.floor(i / 32).cast("int"), F.get(s["ra"], i)),
            )

        return F.struct(s["b"].alias("a"), _let(digest, shifted).alias("b"), s["rb"].alias("ra"), s["ra"].alias("rb"))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one_round)
    return _let(end, lambda s: F.concat(s["a"], s["b"]))


def _characters(text: Column) -> Column:
    return F.split(text, "")


def _permute_text(text: Column, kind: str, key: str, hexadecimal: bool = False) -> Column:
    """``text`` with digits and letters permuted among their like and all else in its place, letters of no alphabet too."""
    letters = F.filter(_characters(text), lambda c: c.rlike("[\\p{L}\\p{N}]"))
    alphabets = [_DIGIT + "abcdef"] if hexadecimal else ALPHABETS
    every, ends = F.lit("".join(alphabets)), list(accumulate(map(len, alphabets)))

    def of_alphabet(place: Column, value: list[int], none: int) -> Column:
        """The value of the alphabet that a place in ``every`` belongs to."""
        expr = F.when(place == 0, F.lit(none))
        for end, v in zip(ends[:-1], value):
            expr = expr.when(place <= end, F.lit(v))
        return expr.otherwise(F.lit(value[-1]))

    def before(place: Column) -> Column:
        return of_alphabet(place, [0, *ends[:-1]], -1)

    def rebuilt(places: Column) -> Column:
        radices = F.transform(places, lambda p: of_alphabet(p, list(map(len, alphabets)), 1))
        codes = F.transform(places, lambda p: p - before(p) - 1)
        new = permute(codes, radices, F.concat(F.lit(kind + "/"), F.array_join(radices.cast("array<string>"), ",")), key)
        put = F.zip_with(places, new, lambda p, value: F.when(p > 0, F.substr(every, before(p) + 1 + value, F.lit(1))))
        return _let(put, lambda chosen: _refill(text, chosen))

    return _let(F.transform(letters, lambda c: F.instr(every, c)), rebuilt)


def _refill(text: Column, letters: Column) -> Column:
    """``text`` with its letters and digits replaced, in order, by ``letters``."""
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("done"))

    def step(s: Column, c: Column) -> Column:
        is_letter = c.rlike("[\\p{L}\\p{N}]")
        return F.struct(
            (s["n"] + is_letter.cast("int")).alias("n"),
            F.concat(s["done"], F.when(is_letter, F.coalesce(F.get(letters, s["n"]), c)).otherwise(c)).alias("done"),
        )

    return F.aggregate(_characters(text), start, step, lambda s: s["done"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum of digits where those at an even (0) or odd (1) distance from the end count double."""
    each = F.transform(F.reverse(_characters(digits)), lambda c, i: _let(
        c.cast("int") * F.when(i % 2 == doubled, 2).otherwise(1), lambda x: x - F.when(x > 9, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _mod97(text: Column) -> Column:
    """The IBAN remainder of letters and digits, the first four moved to the end."""
    moved = F.concat(F.substr(text, F.lit(5)), F.substr(text, F.lit(1), F.lit(4)))
    return F.aggregate(
        _characters(moved),
        F.lit(0),
        lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97).cast("int"),
    )


def _card(text: Column, key: str) -> Column:
    digits = _digits(text)
    body = _permute_text(F.substr(digits, F.lit(1), F.length(digits) - 1), "card", key)
    made = _let(body, lambda b: F.concat(b, F.pmod(-_luhn_sum(b, 0), F.lit(10)).cast("string")))
    return _let(made, lambda m: _refill(text, _characters(m)))


def _iban(text: Column, key: str) -> Column:
    plain = F.replace(text, F.lit(" "), F.lit(""))
    body = _permute_text(F.substr(plain, F.lit(5)), "iban", key)
    country = F.substr(plain, F.lit(1), F.lit(2))
    made = _let(body, lambda b: F.concat(country, F.lpad((98 - _mod97(F.concat(country, F.lit("00"), b))).cast("string"), 2, "0"), b))
    return _let(made, lambda m: _refill(text, _characters(m)))


def _valid_iban(text: Column) -> Column:
    plain = F.replace(text, F.lit(" "), F.lit(""))
    return F.length(plain).between(15, 34) & (_mod97(plain) == 1)


def _vector(numbers: list[Column], radices: list[int], tweak: str, key: str) -> Column:
    return permute(F.array(*[n.cast("int") for n in numbers]), F.array(*map(F.lit, radices)), F.lit(tweak), key)


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.coalesce(F.regexp_extract(text, pattern, group).try_cast("int"), F.lit(0))


def _ip(text: Column, key: str) -> Column:
    octets = F.split(text, "\\.")
    new = _vector([F.coalesce(F.get(octets, F.lit(i)).try_cast("int"), F.lit(0)) for i in range(4)], [256] * 4, "ip", key)
    return F.array_join(new.cast("array<string>"), ".")


def _valid_ip(text: Column) -> Column:
    return F.forall(F.split(text, "\\."), lambda o: (o.try_cast("int") <= 255) & ((F.length(o) == 1) | ~o.startswith("0")))


_SSN = "^([0-9]{3})-([0-9]{2})-([0-9]{4})$"


def _valid_ssn(text: Column) -> Column:
    area = _part(text, _SSN, 1)
    return area.between(1, 899) & (area != 666) & (_part(text, _SSN, 2) > 0) & (_part(text, _SSN, 3) > 0)


def _ssn(text: Column, key: str) -> Column:
    area = _part(text, _SSN, 1)
    rank = area - 1 - (area > 666).cast("int")
    new = _vector([rank, _part(text, _SSN, 2) - 1, _part(text, _SSN, 3) - 1], [898, 99, 9999], "ssn", key)
    return _let(new, lambda v: F.concat_ws(
        "-",
        F.lpad((F.get(v, F.lit(0)) + 1 + (F.get(v, F.lit(0)) >= 665).cast("int")).cast("string"), 3, "0"),
        F.lpad((F.get(v, F.lit(1)) + 1).cast("string"), 2, "0"),
        F.lpad((F.get(v, F.lit(2)) + 1).cast("string"), 4, "0"),
    ))


#: Pattern of a date -> its formats; where two are possible the second is for dates that the first can't read.
_FORMATS = {
    "^[0-9]{4}-": ["yyyy-MM-dd"],
    "^[0-9]{4}/": ["yyyy/MM/dd"],
    "^[0-9]{2}\\.": ["dd.MM.yyyy"],
    "^[0-9]{2}/": ["MM/dd/yyyy", "dd/MM/yyyy"],
    "^[0-9]{2}-": ["dd-MM-yyyy", "MM-dd-yyyy"],
}


def _date(text: Column, key: str) -> Column:
    """The pseudonym of a date; null for what is no date, or out of range.

    A date that the first of its formats reads is permuted among all dates of the range.
    Another, whose day is after the 12th, is permuted among such dates of 1900 to 2099, so
    that the first format doesn't read its pseudonym either: to the 28th it changes year,
    month and day; the 29th to 31st keep day and month, and a leap day goes to a leap year.
    """
    found = F
    for pattern, forms in _FORMATS.items():
        for late, form in enumerate(forms):
            day = F.try_to_timestamp(text, F.lit(form)).cast("date")
            found = found.when(text.rlike(pattern) & day.isNotNull(), F.struct(day.alias("day"), F.lit(form).alias("form"), F.lit(bool(late)).alias("late")))
    first = F.lit(FIRST_DAY).cast("date")

    def permuted(x: Column) -> Column:
        offset = F.date_diff(x["day"], first)
        y, m, d = F.year(x["day"]), F.month(x["day"]), F.dayofmonth(x["day"])
        kinds = [  # in this case, these numbers below these radices
            (~x["late"], "date", [F.floor(offset / DAYS), offset % DAYS], [YEARS, DAYS]),
            (d <= 28, "late date", [y - 1900, m - 1, d - 13], [200, 12, 16]),
            ((m == 2) & (d == 29), "leap day", [F.floor((y - 1904) / 4)], [49]),
            (F.lit(True), "last days", [y - 1900], [200]),
        ]

        def chosen(value) -> Column:
            expr = F
            for case, *rest in kinds:
                expr = expr.when(case, value(*rest))
            return expr

        numbers = chosen(lambda tweak, values, radices: F.array(*[v.cast("int") for v in values]))
        new = permute(numbers, chosen(lambda t, v, radices: F.array(*map(F.lit, radices))), chosen(lambda tweak, v, r: F.lit(tweak)), key)

        def dated(v: Column) -> Column:
            a, b, c = (F.get(v, F.lit(i)) for i in range(3))
            on = lambda y, m, d: F.make_date(y.cast("int"), m.cast("int"), d.cast("int"))
            day = F.when(~x["late"], F.date_add(first, (a * DAYS + b).cast("int"))).when(d <= 28, on(a + 1900, b + 1, c + 13))
            return day.when((m == 2) & (d == 29), on(a * 4 + 1904, m, d)).otherwise(on(a + 1900, m, d))

        inside = F.when(x["late"], y.between(1900, 2099)).otherwise(offset.between(0, YEARS * DAYS - 1))
        return F.when(inside, F.call_function("date_format", _let(new, dated), x["form"]))

    return _let(found, permuted)


def _split_at(text: Column, pattern: str, change) -> Column:
    """The part that ``pattern`` matches at the start as it is, the rest changed."""
    head = F.regexp_extract(text, pattern, 0)
    return F.concat(head, change(F.substr(text, F.length(head) + 1)))


def _email(text: Column, key: str) -> Column:
    user, host = F.substring_index(text, "@", 1), F.substring_index(text, "@", -1)
    return F.concat(_permute_text(user, "email", key), F.lit("@"), host)


def _handlers(key: str) -> dict:
    """kind -> the pseudonym of a candidate's text, null where the candidate fails its check."""
    return {
        "email": lambda m: _email(m, key),
        "secret": lambda m: _split_at(m, "^.*?[=:]\\s{0,3}[\"']?", lambda x: _permute_text(x, "secret", key, hexadecimal=True)),
        "iban": lambda m: F.when(_valid_iban(m), _iban(m, key)),
        "phone": lambda m: _split_at(m, _CODE, lambda x: _permute_text(x, "phone", key)),
        "date": lambda m: _date(m, key),
        "ssn": lambda m: F.when(_valid_ssn(m), _ssn(m, key)),
        "ip": lambda m: F.when(_valid_ip(m), _ip(m, key)),
        "card": lambda m: F.when(_luhn_sum(_digits(m), 1) % 10 == 0, _card(m, key)),
    }


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, the text with pseudonyms, n_found, and a count n_<kind> for every kind.

    Reads ``doc_id`` and ``text``, whatever else is there. Null texts stay null with zero
    counts; texts without candidates come back unchanged; repeated rows are treated
    alike, and of candidates that begin at one place the first kind of PATTERNS counts.
    An empty table gives no rows, a very long text is searched whole. One pass, no
    shuffle, nothing outside the row is needed.
    """
    handlers = _handlers(key)
    whole = {k: f"^(?:{p})$" for k, p in PATTERNS.items()}

    def handled(m: Column) -> Column:
        # a candidate stands alone here: what must not be around it was seen to when it was found
        kind = F
        for k in KINDS:
            kind = kind.when(m.rlike(whole[k]), F.lit(k))

        def made(kind: Column) -> Column:
            value = F
            for k in KINDS:
                value = value.when(kind == k, handlers[k](m))
            return _let(value, lambda v: F.struct(F.when(v.isNull(), "").otherwise(kind).alias("kind"), F.coalesce(v, m).alias("value")))

        return _let(kind, made)

    found = F.transform(F.regexp_extract_all("text", F.lit(ANY), F.lit(0)), handled)
    searched = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike("[0-9@]"), F.lit(False)).alias("_any"))
    nothing = F.lit(None).cast("array<struct<kind:string,value:string>>")
    marked = searched.withColumn("_found", F.when(F.col("_any"), found).otherwise(nothing))
    between = F.split("text", ANY, -1)
    parts = F.transform(F.col("_found"), lambda x: x["value"])
    joined = F.array_join(F.zip_with(between, F.concat(parts, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    text = F.when(F.size("_found") > 0, joined).otherwise(F.col("text"))

    def tally(kind: str | None) -> Column:
        hits = F.filter(F.col("_found"), lambda x: x["kind"] != "" if kind is None else x["kind"] == kind)
        return F.when(F.size("_found") > 0, F.size(hits)).otherwise(0).cast("long")

    return marked.select("doc_id", text.alias("text"), tally(None).alias("n_found"), *[tally(k).alias(f"n_{k}") for k in KINDS])
