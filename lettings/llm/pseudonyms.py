"""Format-preserving Feistel pseudonyms for validated numbers and dates, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 8
KEY = "demo-key"
# The shapes looked for.  Digits do not touch a further digit or letter.
# Phones: with a plus 8 to 15 digits, or the North American form with brackets, dots or dashes.
LOCAL = r"(?<![0-9A-Za-z+])(?:1[ .-])?(?:\([0-9]{3}\)[ ]?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"
PHONE = r"(?<![0-9A-Za-z+])\+[0-9](?:[ .()-]{0,2}[0-9]){7,14}(?![0-9A-Za-z])|" + LOCAL
ADDRESS = r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z])(?!\.[0-9])"
# A domain has 127 parts at most; loops over parts are bounded or possessive, as others recurse once a part.
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,125}\.[A-Za-z]{2,}(?![A-Za-z0-9])"
ISO = r"(?<![0-9A-Za-z-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9A-Za-z-])"
YEAR_LAST = "|".join(f"[0-9]{{1,2}}{m}[0-9]{{1,2}}{m}[0-9]{{4}}" for m in ("/", "-", r"\."))
DATE = ISO + rf"|(?<![0-9A-Za-z])(?<![0-9][./-])(?:[0-9]{{4}}/[0-9]{{1,2}}/[0-9]{{1,2}}|{YEAR_LAST})(?![0-9A-Za-z]|[./-][0-9])"
# Groups of digits of 13 digits or more, up to a value of another kind; the cards are looked for among the groups.
GROUP = rf"(?!{LOCAL}|{DATE}|{ADDRESS}|{MAIL})[0-9]++(?![A-Za-z])"
# Between groups stand one or two blanks (plain, no-break or thin) or dashes, or one dot.
MARK = r"(?:[ \u00A0\u2009\u202F-]{1,2}+|\.)"
CARD = rf"(?<![0-9A-Za-z])(?=[0-9](?:{MARK}?[0-9]){{12}}){GROUP}(?:{MARK}{GROUP})*+"
KINDS = {"mails": MAIL, "phones": PHONE, "addresses": ADDRESS, "dates": DATE, "cards": CARD}
ANY = "|".join(KINDS.values())
# The days of a date's domain: 250 times 292 from the first one, so that two halves fit exactly.
FIRST_DAY, DAY_A, DAY_B = "1900-01-01", 250, 292
#: Groups of digits looked at in a row.
STRETCH = 64


def prf(key: str, domain: str, i: int, value: Column) -> Column:
    """Keyed pseudo-random number below 2^48."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(key), F.lit(f"{domain}:{i}"), value), 256), 1, 12), 16, 10).cast("long")


def feistel(pair: Column, a: Column, b: Column, key: str, domain: str, tweak: Column) -> Column:
    """A keyed permutation of the pairs (l below a, r below b): in turn one half is shifted by a hash of the other."""
    out = pair
    for i in range(ROUNDS):
        out = step(out, a, b, key, domain, tweak, i)
    return out


def step(pair: Column, a: Column, b: Column, key: str, domain: str, tweak: Column, i: int) -> Column:
    def changed(p: Column) -> Column:
        other = p["r"] if i % 2 == 0 else p["l"]
        noise = prf(key, domain, i, F.concat_ws(":", tweak, other))
        left = F.pmod(p["l"] + noise, a) if i % 2 == 0 else p["l"]
        right = p["r"] if i % 2 == 0 else F.pmod(p["r"] + noise, b)
        return F.struct(left.alias("l"), right.alias("r"))

    # a one-element array gives the step a name to use twice, so that it is computed once
    return F.transform(F.array(pair), changed)[0]


def permuted_digits(digits: Column, key: str, domain: str) -> Column:
    """Digits of up to 30 permuted among all of the same length."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")

    def encrypted(parts: Column) -> Column:
        pair = F.struct(parts["left"].cast("long").alias("l"), parts["right"].cast("long").alias("r"))
        a, b = F.pow(F.lit(10), F.length(parts["left"])).cast("long"), F.pow(F.lit(10), F.length(parts["right"])).cast("long")
        out = feistel(pair, a, b, key, domain, F.length(parts["left"]) + F.length(parts["right"]))
        return F.transform(F.array(out), lambda o: F.concat(
            F.lpad(o["l"].cast("string"), F.length(parts["left"]), F.lit("0")),
            F.lpad(o["r"].cast("string"), F.length(parts["right"]), F.lit("0")),
        ))[0]

    parts = F.struct(F.substr(digits, F.lit(1), half).alias("left"), F.substr(digits, half + 1).alias("right"))
    return F.transform(F.array(parts), encrypted)[0]


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of the digits; the last one is not doubled."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.pmod(d.cast("int") * 2, F.lit(10)) + F.floor(d.cast("int") / 5).cast("int")
    ))
    return F.aggregate(places, F.lit(0), lambda n, d: n + d)


def refill(shape: Column, digits: Column) -> Column:
    """The text ``shape`` with its digits replaced in turn by ``digits``."""
    gaps = F.regexp_extract_all(shape, F.lit("([^0-9]*)[0-9]"), F.lit(1))
    filled = F.zip_with(gaps, F.split(digits, ""), lambda g, d: F.concat(F.coalesce(g, F.lit("")), F.coalesce(d, F.lit(""))))
    return F.concat(F.array_join(filled, ""), F.regexp_extract(shape, "([^0-9]*)$", 1))


def card(value: Column, key: str) -> Column:
    """A card number: all digits but the check digit permuted, then the check digit that fits."""
    digits = F.regexp_replace(value, "[^0-9]", "")

    def changed(d: Column) -> Column:
        body = permuted_digits(F.substr(d, F.lit(1), F.length(d) - 1), key, "card")
        return F.transform(F.array(body), lambda x: F.concat(
            x, F.pmod(F.lit(10) - F.pmod(luhn_sum(F.concat(x, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
        ))[0]

    return refill(value, F.transform(F.array(digits), changed)[0])


def phone(value: Column, key: str) -> Column:
    """A phone number: the digits after the country's code permuted."""
    head = F.regexp_extract(value, r"^\+(?:[0-9]{1,3}(?![0-9])|[17]|[0-9]{2})", 0)
    rest = F.substr(value, F.length(head) + 1)
    return F.concat(head, refill(rest, permuted_digits(F.regexp_replace(rest, "[^0-9]", ""), key, "phone")))


def address(value: Column, key: str) -> Column:
    """An IPv4 address permuted among all of them."""
    parts = F.transform(F.split(value, r"\."), lambda p: p.cast("long"))

    def changed(p: Column) -> Column:
        pair = F.struct((p[0] * 256 + p[1]).alias("l"), (p[2] * 256 + p[3]).alias("r"))
        return F.transform(F.array(feistel(pair, F.lit(65536), F.lit(65536), key, "address", F.lit(""))), lambda o: F.concat_ws(
            ".", F.floor(o["l"] / 256), o["l"] % 256, F.floor(o["r"] / 256), o["r"] % 256
        ))[0]

    return F.transform(F.array(parts), changed)[0]


def date(value: Column, key: str) -> Column:
    """A date permuted among the days of the domain, in its own order of year, month and day."""
    mark, iso = F.regexp_extract(value, "[^0-9]", 0), day_of(value)
    day = F.datediff(iso, F.lit(FIRST_DAY))
    first, second = F.when(month_first(value), F.lit("MM")).otherwise("dd"), F.when(month_first(value), F.lit("dd")).otherwise("MM")
    form = F.when(value.rlike("^[0-9]{4}"), F.concat_ws("x", F.lit("yyyy"), F.lit("MM"), F.lit("dd"))).otherwise(
        F.concat_ws("x", first, second, F.lit("yyyy"))
    )

    def changed(n: Column) -> Column:
        pair = F.struct(F.floor(n / DAY_B).cast("long").alias("l"), (n % DAY_B).cast("long").alias("r"))
        out = feistel(pair, F.lit(DAY_A), F.lit(DAY_B), key, "date", F.lit(""))
        return F.transform(F.array(out), lambda o: F.date_format(
            F.date_add(F.to_date(F.lit(FIRST_DAY)), (o["l"] * DAY_B + o["r"]).cast("int")), "yyyy-MM-dd"
        ))[0]

    def written(iso_out: Column) -> Column:
        parts = F.split(iso_out, "-")
        ordered = F.transform(F.array(parts), lambda p: F.transform(
            F.split(form, "x"), lambda c: F.when(c == "yyyy", p[0]).when(c == "MM", p[1]).otherwise(p[2])
        ))
        return F.transform(ordered, lambda p: F.concat(p[0], mark, p[1], mark, p[2]))[0]

    return F.transform(F.transform(F.array(day), changed), written)[0]


def month_first(value: Column) -> Column:
    """Whether the month stands before the day: not with dots, nor where the first number is above 12."""
    return ~F.contains(value, F.lit(".")) & (F.split(value, "[./-]")[0].cast("int") <= 12)


def day_of(value: Column) -> Column:
    """The day that a found date names, null where the calendar has none."""
    parts = F.split(value, "[./-]")
    return F.try_to_date(F.when(value.rlike("^[0-9]{4}"), F.concat_ws("-", parts[0], parts[1], parts[2])).when(
        month_first(value), F.concat_ws("-", parts[2], parts[0], parts[1])
    ).otherwise(F.concat_ws("-", parts[2], parts[1], parts[0])), "yyyy-M-d")


def cards_in(value: Column) -> Column:
    """Groups of digits cut in pieces (v, kind): the cards, and what stands between them.

    From each group of four digits on, the windows of whole groups with 13 to 19 digits and
    a fitting check digit are cards, if dots stand between all groups or none; 4-4-4-4,
    4-6-5, 4-6-4 and single groups come before longer ones.
    """
    both = F.struct(F.split(value, MARK).alias("groups"), F.regexp_extract_all(value, F.lit(MARK), F.lit(0)).alias("marks"))
    return F.transform(F.array(both), lambda b: card_pieces(b["groups"], b["marks"]))[0]


def card_pieces(groups: Column, marks: Column) -> Column:
    """The groups are gone through in stretches, so that no list grows group by group over a long text."""
    n = F.size(groups)

    def ends(i: Column) -> Column:
        def rank(k: Column) -> Column:
            window, between = F.slice(groups, i + 1, k), F.slice(marks, i + 1, k - 1)
            digits = F.array_join(window, "")
            shape = F.array_join(F.transform(window, lambda g: F.length(g).cast("string")), "-")
            dots = F.size(F.filter(between, lambda m: m == "."))
            fits = F.length(digits).between(13, 19) & (F.pmod(luhn_sum(digits), F.lit(10)) == 0) & dots.isin(F.lit(0), k - 1)
            usual = (k == 1) | shape.isin("4-4-4-4", "4-6-5", "4-6-4")
            return F.when(fits, F.when(usual, F.lit(100)).otherwise(F.lit(0)) + k)
        ranks = F.transform(F.sequence(F.lit(1), F.least(n - i, F.lit(16))), rank)
        return F.when(F.length(groups[i]) >= 4, F.array_max(ranks))

    def grown(state: Column, i: Column) -> Column:
        best = F.when(state["free"] <= i, ends(i))

        def with_card(last: Column) -> Column:
            cut = F.array(F.struct(i.alias("a"), last.alias("b")))
            return F.struct(
                F.coalesce(last + 1, state["free"]).alias("free"),
                F.when(last.isNull(), state["cuts"]).otherwise(F.concat(state["cuts"], cut)).alias("cuts"),
            )
        return F.transform(F.array(i + F.pmod(best, F.lit(100)) - 1), with_card)[0]

    def stretch(state: Column, first: Column) -> Column:
        inside = F.sequence(first, F.least(first + STRETCH, n) - 1)
        start = F.struct(state["free"].alias("free"), F.array().cast("array<struct<a:int,b:int>>").alias("cuts"))
        return F.transform(F.array(F.aggregate(inside, start, grown)), lambda s: F.struct(
            s["free"].alias("free"), F.concat(state["all"], F.array(s["cuts"])).alias("all")
        ))[0]

    nothing = F.struct(F.lit(0).alias("free"), F.array().cast("array<array<struct<a:int,b:int>>>").alias("all"))
    cuts = F.aggregate(F.sequence(F.lit(0), n - 1, F.lit(STRETCH)), nothing, stretch, lambda s: F.flatten(s["all"]))
    led = F.zip_with(F.concat(F.array(F.lit("")), marks), groups, lambda m, g: F.concat(m, g))

    def pieces(x: Column) -> Column:
        cut, lead = x["cuts"], x["led"]

        def joined(first: Column, last: Column) -> Column:
            return F.array_join(F.slice(lead, first + 1, last - first + 1), "")

        def both(c: Column, nth: Column) -> Column:
            before = F.coalesce(F.get(cut, nth - 1)["b"] + 1, F.lit(0))
            mark = F.when(c["a"] > 0, F.get(marks, c["a"] - 1)).otherwise(F.lit(""))
            return F.array(
                F.struct(F.concat(joined(before, c["a"] - 1), mark).alias("v"), F.lit(None).cast("string").alias("kind")),
                F.struct(F.concat(groups[c["a"]], joined(c["a"] + 1, c["b"])).alias("v"), F.lit("cards").alias("kind")),
            )
        after = F.coalesce(F.try_element_at(cut, F.lit(-1))["b"] + 1, F.lit(0))
        rest = F.struct(joined(after, n - 1).alias("v"), F.lit(None).cast("string").alias("kind"))
        return F.concat(F.flatten(F.transform(cut, both)), F.array(rest))

    return F.transform(F.array(F.struct(cuts.alias("cuts"), led.alias("led"))), pieces)[0]


def mail(value: Column, key: str) -> Column:
    """A mail address: letters and digits of the local part replaced by keyed ones of the same kind, the domain by a reserved one."""
    local = F.substring_index(value, "@", 1)
    code = F.sha2(F.concat_ws(":", F.lit(key), F.lit("mail"), F.lower(value)), 256)
    return F.transform(F.array(code), lambda h: F.concat(
        F.array_join(F.transform(F.split(local, ""), lambda c, i: F.when(
            c.rlike("[0-9]"), F.substr(F.translate(h, "abcdef", "012345"), F.pmod(i, F.lit(64)) + 1, F.lit(1))
        ).when(
            c.rlike("[A-Za-z]"), F.substr(F.translate(h, "0123456789", "ghijklmnop"), F.pmod(i, F.lit(64)) + 1, F.lit(1))
        ).otherwise(c)), ""),
        F.lit("."), F.translate(F.substr(h, F.lit(41), F.lit(12)), "0123456789", "ghijklmnop"), F.lit("@example.invalid"),
    ))[0]


def kind_of(value: Column) -> Column:
    """The kind of a found text that is no row of groups, null where it is not valid."""
    day = day_of(value)
    return (
        F.when(F.contains(value, F.lit("@")), F.lit("mails"))
        .when(F.startswith(value, F.lit("+")) | value.rlike(f"^(?:{LOCAL})$"), F.lit("phones"))
        .when(value.rlike(f"^(?:{DATE})$"), F.when(
            day.isNotNull() & F.datediff(day, F.lit(FIRST_DAY)).between(0, DAY_A * DAY_B - 1), F.lit("dates")
        ))
        .when(F.forall(F.split(value, r"\."), lambda p: p.cast("int") < 256), F.lit("addresses"))
    )


def is_groups(value: Column) -> Column:
    """Whether a found text is a row of groups of digits: what has the shape of no other kind.

    ``CARD`` itself does not tell, as it looks at what stands around a text and counts digits beyond its end.
    """
    return ~(F.contains(value, F.lit("@")) | F.startswith(value, F.lit("+")) | value.rlike(f"^(?:{LOCAL}|{DATE}|{ADDRESS})$"))


def pseudonymise(docs: DataFrame, key: str = KEY, text: str = "text") -> DataFrame:
    """Replaces the values in ``text`` and adds ``n_cards``, ``n_phones``, ``n_addresses``, ``n_dates``, ``n_mails``.

    Cards (Luhn), IPv4 addresses (parts below 256) and dates (of the calendar, from 1900 on
    for 73,000 days) are permuted within their format by a keyed Feistel network, phone
    numbers likewise; so equal values are equal after it in all documents, different ones
    different, and who has the key can undo it.  Mail addresses have no fixed format to
    permute in; they get a keyed pseudonym with the same shape of the local part.

    Cards are found among groups of digits with one or two blanks (also no-break and thin
    ones) or dashes, or with dots, between them, not where a letter touches the digits; phones with a plus
    (8 to 15 digits) or as North American ones with brackets, dots or dashes; dates as
    yyyy-mm-dd, yyyy/mm/dd and with the year last (by dots the day first, else the month
    first if it can be).  Plain digits without a plus are no phone, and names of months no date;
    dates that read as month first and day first can become equal.

    Texts without a value, empty and null texts stay as they are (counts 0); invalid
    values stay; long texts are read whole; repeated rows are changed alike; an empty table
    gives no rows; columns named as an added one are replaced.
    """
    names = [f"n_{k}" for k in KINDS]
    found = docs.drop(*names).withColumn("__found", F.transform(
        F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(ANY), F.lit(0)),
        lambda v: F.when(is_groups(v), cards_in(v)).otherwise(
            F.array(F.struct(v.alias("v"), kind_of(v).alias("kind")))
        ),
    ))

    def changed(f: Column) -> Column:
        v = f["v"]
        return (
            F.when(f["kind"] == "mails", mail(v, key)).when(f["kind"] == "phones", phone(v, key))
            .when(f["kind"] == "addresses", address(v, key)).when(f["kind"] == "dates", date(v, key))
            .when(f["kind"] == "cards", card(v, key)).otherwise(v)
        )

    between = F.split(F.col(text), ANY, -1)
    filled = F.zip_with(between, F.transform("__found", lambda m: F.array_join(F.transform(m, changed), "")), lambda t, v: F.concat(t, F.coalesce(v, F.lit(""))))
    counts = {n: count(k) for n, k in zip(names, KINDS, strict=True)}
    return found.withColumns({
        **counts, text: F.when(F.size("__found") > 0, F.array_join(filled, "")).otherwise(F.col(text)),
    }).drop("__found")


def count(kind: str) -> Column:
    return F.size(F.filter(F.flatten("__found"), lambda f: f["kind"] == kind)).cast("long")
