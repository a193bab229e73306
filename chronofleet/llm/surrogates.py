"""Personal data replaced by keyed surrogates, with DataFrame functions only.

Entities are found by pattern and, where the kind has one, by check digit. Each has a canonical
form (letters in lower case, bare digits), so that all spellings of one entity are one. Its surrogate
is a function of key, kind and canonical form: same kind, length, script, gender and valid check
digits; it is laid over the spelling found, keeping separators and case. A table of all
entities is checked for collisions: no two entities of a kind share a surrogate and no surrogate is
an entity of the corpus; the later of two draws again until none is left. Names and local parts of
e-mails get longer with every second draw, so that there are always enough. Within a text a title
with a family name, and mentions without a title, follow the full name they are short for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofleet.llm.common import saved, table

_WORD = r"\p{L}\p{N}_"
_TITLES_M = "mr|herr|monsieur|señor|sr|господин"
_TITLES_F = "mrs|ms|miss|frau|madame|mme|señora|sra|госпожа"
_DOCTORS = "dr|prof|professor|doktor|dra"
_FURTHER = rf"{_DOCTORS}|ing|dipl|rev"
_GAP = r"[ \t]"
_TITLE = rf"(?:{_TITLES_M}|{_TITLES_F}|{_DOCTORS})\.?{_GAP}(?:(?:{_FURTHER})\.?{_GAP})*"
#: A capital with letters of both cases behind it, joined by hyphens or apostrophes, or an initial.
_PART = r"(?-i:\p{Lu}(?:\.|(?=[\p{L}\p{M}'’-]*\p{Ll})[\p{L}\p{M}]*+(?:['’-]\p{L}[\p{L}\p{M}]++)*+))"
_SMALL = r"(?-i:(?:von|van|de|der|den|del|della|di|da|dos|du|la|le|zu|zum|zur|al|el|ter|ten)[ \t])*"
#: Length of the part behind the check digits, by country.
_BBAN = {11: "no", 12: "be", 14: "dk|fi|fo|gl|nl", 15: "mk|si", 16: "at|ba|ee|kz|lt|lu|xk", 17: "ch|cr|hr|li|lv", 18: "bg|bh|de|ge|gb|ie|me|rs|va", 19: "ae|gi|il|iq|tl", 20: "ad|cz|es|md|pk|ro|sa|se|sk|tn|vg", 21: "pt", 22: "is|tr", 23: "fr|gr|it|mc|mr|sm", 24: "al|az|by|cy|do|gt|hu|lb|pl|sv", 25: "br|eg|ps|qa|ua", 26: "jo|kw|mu", 27: "mt|sc", 28: "lc"}
_IBANS = "|".join(rf"(?:{c})\d{{2}}(?: ?[a-z0-9]{{4}}){{{n // 4}}}" + (rf" ?[a-z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in _BBAN.items())
#: Kind and pattern, the first that matches counts. No pattern starts inside a word.
PATTERNS = {
    "email": rf"(?<![{_WORD}.%+-])[{_WORD}.%+-]++@[{_WORD}-]+(?:\.[{_WORD}-]+)*\.\p{{L}}{{2,}}",
    "secret": rf"(?<![{_WORD}])(?:[0-9a-f]{{32,}}+|akia[0-9a-z]{{16}}|ghp_[0-9a-z]{{36}}|sk-[0-9a-z]{{20,}}+)(?![{_WORD}])",
    "ip": rf"(?<![{_WORD}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){{3}}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![{_WORD}]|\.\d)",
    "iban": rf"(?<![{_WORD}])(?:(?:{_IBANS})(?![{_WORD}])|[a-z]{{2}}\d{{2}}(?: ?\d{{4}}){{3,7}}(?: ?\d{{1,3}})?(?![{_WORD}]))",
    "ssn": rf"(?<![{_WORD}-])\d{{3}}-\d{{2}}-\d{{4}}(?![{_WORD}-])",
    "card": rf"(?<![{_WORD}])(?:\d{{13,19}}|\d{{4}}(?: \d{{4}}){{3}}|\d{{4}}(?:-\d{{4}}){{3}}|\d{{4}} \d{{6}} \d{{5}}|\d{{4}}-\d{{6}}-\d{{5}})(?![{_WORD}])",
    "phone": rf"(?<![{_WORD}+])(?:\+\d{{1,3}}[ .-]?)?(?:\(\d{{2,4}}\)[ .-]?\d{{3,4}}[ .-]?\d{{3,4}}|\d{{2,4}}[ .-]\d{{3,4}}[ .-]\d{{3,4}})(?![{_WORD}])|(?<![{_WORD}+])\+(?:[ .()-]{{0,2}}\d){{8,15}}(?![{_WORD}])",
    "name": rf"(?<![{_WORD}])(?:{_TITLE}){_SMALL}{_PART}(?:{_GAP}(?!(?:{_TITLES_M}|{_TITLES_F}|{_DOCTORS})\b){_SMALL}{_PART})*",
}
PATTERN = "(?i)(?:" + "|".join(PATTERNS.values()) + ")"
DIGIT_KINDS = ("card", "phone", "ssn")
#: Country calling codes of one and of two digits; all others have three.
_CODES_1 = "1|7"
_CODES_2 = "20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
#: Parts of made-up names by script, with the endings of each gender.
NAME_PARTS = {
    "latin": ("ba be bo da de do fa fe ga go ka ke ki la le lo ma me mi na ne no ra re ri sa se so ta te to va ve", {"m": "n", "f": "a"}),
    "cyrillic": ("ба бе бо да де до га го ка ке ки ла ле ло ма ме ми на не но ра ре ри са се со та те то ва ве", {"m": "н", "f": "а"}),
    "greek": ("βα βε βο δα δε δο γα γο κα κε κι λα λε λο μα με μι να νε νο ρα ρε ρι σα σε σο τα τε το φα φε", {"m": "ς", "f": "α"}),
}


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string; a valid number has a multiple of 10."""
    back = F.reverse(F.split(digits, "(?!^)(?!$)"))
    value = F.transform(back, lambda d, i: d.cast("int") * (1 + i % 2))
    return F.aggregate(value, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v))


def _mod97(text: Column) -> Column:
    """Remainder by 97 of a string of digits and letters, letters counting as two digits."""
    def step(a, c):
        n = F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 87)
        return F.when(n < 10, (a * 10 + n) % 97).otherwise((a * 100 + n) % 97)

    return F.aggregate(F.split(F.lower(text), "(?!^)(?!$)"), F.lit(0), step)


def kind_of(entity: Column) -> Column:
    """The kind of a match, null where its check digit rules it out."""
    kind = F.lit(None).cast("string")
    for name in reversed(PATTERNS):
        kind = F.when(entity.rlike("(?i)^(?:" + PATTERNS[name] + ")$"), F.lit(name)).otherwise(kind)
    card = F.when(_digits(entity).rlike("^[2-6]") & (_luhn_sum(_digits(entity)) % 10 == 0), F.lit("card"))
    plain = F.regexp_replace(entity, " ", "")
    iban = F.when(_mod97(F.concat(F.substring(plain, 5, 99), F.substring(plain, 1, 4))) == 1, F.lit("iban"))
    return F.when(kind == "card", card).when(kind == "iban", iban).otherwise(kind)


def canonical(kind: Column, entity: Column) -> Column:
    name = F.translate(F.regexp_replace(F.lower(entity), "^" + _TITLE, ""), "’\t", "' ")
    gender = F.when(F.lower(entity).rlike(rf"^(?:{_TITLES_F}|dra)\b"), "f").otherwise("m")
    abroad = F.when((kind == "phone") & entity.startswith("+"), "+").otherwise("")
    return F.when(kind.isin(*DIGIT_KINDS), F.concat(abroad, _digits(entity))).when(kind == "iban", F.regexp_replace(F.lower(entity), " ", "")).when(kind == "name", F.concat(gender, F.lit(" "), name)).otherwise(F.lower(entity))


def _draw(seed: Column, i: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(seed, i), F.lit(n)).cast("int")


def _letters(seed: Column, text: Column, hexes: bool = False) -> Column:
    """Digits by digits and letters by letters of their script; everything else stays."""
    def one(c, i):
        pick = lambda s: F.substring(F.lit(s), 1, 1) if len(s) == 1 else F.element_at(F.split(F.lit(s), "(?!^)(?!$)"), _draw(seed, i, len(s)) + 1)
        if hexes:
            return F.when(c.rlike("[0-9a-f]"), pick("0123456789abcdef")).when(c.rlike("[g-z]"), pick("ghijkmnopqrstuvwxyz")).otherwise(c)
        return (
            F.when(c.rlike("[0-9]"), pick("0123456789")).when(c.rlike(r"\p{IsCyrillic}"), pick("абвгдежзиклмнопрстуфх")).when(c.rlike(r"\p{IsGreek}"), pick("αβγδεζηθικλμνξοπρστυφχω"))
            .when(c.rlike(r"\p{IsLatin}"), pick("abcdefghijklmnopqrstuvwxyz")).otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, "(?!^)(?!$)"), one), "")


def _name(seed: Column, canon: Column, grown: Column) -> Column:
    """A made-up name with three syllables a word and ``grown`` more."""
    words = F.split(F.substring(canon, 3, 999), " ")

    def made(parts: str, ends: dict[str, str]) -> Column:
        syllables = F.array(*[F.lit(s) for s in parts.split()])
        n = len(parts.split())

        def word(w, i):
            body = F.array_join(F.transform(F.sequence(F.lit(0), 2 + grown), lambda k: F.element_at(syllables, _draw(seed, i * 64 + k, n) + 1)), "")
            # The given name ends as its gender's names do, where a given name is there.
            end = F.when(F.substring(canon, 1, 1) == "f", ends["f"]).otherwise(ends["m"])
            return F.initcap(F.when((i == 0) & (F.size(words) > 1), F.concat(body, end)).otherwise(body))

        return F.array_join(F.transform(words, word), " ")

    return F.when(canon.rlike(r"\p{IsCyrillic}"), made(*NAME_PARTS["cyrillic"])).when(canon.rlike(r"\p{IsGreek}"), made(*NAME_PARTS["greek"])).otherwise(made(*NAME_PARTS["latin"]))


def surrogate(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The canonical surrogate of an entity."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string")), 256)
    # Names and e-mails grow with the draws, as short ones are too few for many entities.
    grown = F.floor(attempt / 2).cast("int")
    # The country code of a phone and the issuer's digit of a card stay.
    code = F.when(canon.rlike(rf"^\+(?:{_CODES_1})"), 2).when(canon.rlike(rf"^\+(?:{_CODES_2})"), 3).when(canon.startswith("+"), 4).otherwise(0)
    lead = F.when(kind == "phone", code).when(kind == "card", F.lit(1)).otherwise(F.lit(0))
    digits = F.concat(F.substring(canon, 1, lead), _letters(seed, F.substring(canon, lead + 1, F.length(canon))))
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    check = F.pmod(-_luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_draw(seed, i, 254) + 1).cast("string")), ".")
    domain_seed = F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), F.substring_index(canon, "@", -1)), 256)
    more = F.substring(F.sha2(F.concat(seed, F.lit("more")), 256), F.lit(1), grown)
    email = F.concat(_letters(seed, F.substring_index(canon, "@", 1)), more, F.lit("@"), F.lit("m"), F.substring(domain_seed, 1, 10), F.lit(".example."), F.element_at(F.array(*[F.lit(x) for x in ("com", "org", "net")]), _draw(domain_seed, F.lit(0), 3) + 1))
    country = F.substring(canon, 1, 2)
    bban = _letters(seed, F.substring(canon, 5, 99))
    iban = F.concat(country, F.lpad((98 - _mod97(F.concat(bban, country, F.lit("00")))).cast("string"), 2, "0"), bban)
    prefix = F.regexp_extract(canon, "^(akia|ghp_|sk-)", 1)
    secret = F.concat(prefix, _letters(seed, F.substring(canon, F.length(prefix) + 1, F.length(canon)), hexes=True))
    return (
        F.when(kind == "email", email).when(kind == "secret", secret).when(kind == "ip", ip).when(kind == "card", F.concat(body, check))
        .when(kind == "iban", iban).when(kind == "name", _name(seed, canon, grown)).otherwise(digits)
    )


def laid_over(kind: Column, entity: Column, made: Column) -> Column:
    """A canonical surrogate in the spelling of the entity found: separators and case."""
    chars, made = F.split(entity, "(?!^)(?!$)"), F.when(kind == "phone", F.translate(made, "+", "")).otherwise(made)
    before = lambda i: F.length(F.regexp_replace(F.substring(entity, F.lit(1), i + 1), "[^0-9a-zA-Z]", ""))
    spaced = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9a-zA-Z]"), F.substring(made, before(i), F.lit(1))).otherwise(c)), "")
    title = F.concat(F.regexp_extract(entity, f"(?i)^({_TITLE})", 1), made)
    out = F.when(kind.isin(*DIGIT_KINDS, "iban"), spaced).when(kind == "name", title).otherwise(made)
    loud = kind.isin("email", "secret", "iban") & (F.upper(entity) == entity) & (F.lower(entity) != entity)
    return F.when(loud, F.upper(out)).otherwise(out)


def drawn(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, made) for distinct (kind, canon), without collisions."""
    made = surrogate(key, F.col("kind"), F.col("canon"), F.col("attempt"))
    rows = saved(entities.withColumn("attempt", F.lit(0)).withColumn("made", made))
    real = entities.select(F.col("kind").alias("real_kind"), F.col("canon").alias("real"))
    while True:
        shared = rows.groupBy("kind", "made").agg(F.count("*").alias("many"), F.min("canon").alias("one")).filter("many > 1")
        again = rows.join(shared, ["kind", "made"]).filter("canon <> one").select("kind", "canon")
        taken = canonical(F.col("kind"), F.when(F.col("kind") == "name", F.concat(F.when(F.substring("canon", 1, 1) == "f", "ms ").otherwise("mr "), F.col("made"))).otherwise(F.col("made")))
        known = rows.withColumn("as_real", taken).join(real, (F.col("kind") == F.col("real_kind")) & (F.col("as_real") == F.col("real"))).select("kind", "canon")
        again = saved(again.union(known).distinct().withColumn("redo", F.lit(1)))
        if again.isEmpty():
            return rows.select("kind", "canon", "made")
        nxt = rows.join(again, ["kind", "canon"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("redo", F.lit(0)))
        rows = saved(nxt.withColumn("made", F.when(F.col("redo") == 1, made).otherwise(F.col("made"))).drop("redo"))


def _aliases(found: DataFrame, kinds: DataFrame, made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names that are short for a full one of their text: (row, canon, short_made) of titled ones, and rules per row for bare ones.

    A title with a family name means the first full name of the text with that family name and
    gender. Untitled mentions of a full name, in any case, and of its family name with a capital are
    replaced too. Rules are (order, pattern, put), full names first.
    """
    names = found.join(kinds.filter("kind = 'name'").select("entity", "canon"), "entity").select("row", "at", "canon", F.split("canon", " ").alias("w"))
    names = names.select("row", "at", "canon", F.size("w").alias("many"), F.get("w", F.lit(0)).alias("gender"), F.element_at("w", -1).alias("family"))
    made = made.filter("kind = 'name'").select("canon", "made")
    full = names.filter("many > 2")
    first = full.groupBy("row", "gender", "family").agg(F.min_by("canon", "at").alias("canon"), F.min("at").alias("at")).join(made, "canon")
    first = first.select("row", "gender", "family", "at", F.element_at(F.split("made", " "), -1).alias("short_made"))
    short = names.filter("many = 2").select("row", "canon", "gender", "family").distinct().join(first, ["row", "gender", "family"]).select("row", "canon", "short_made")

    def rule(order: int, pattern: Column, put: Column) -> Column:
        return F.struct(F.lit(order).alias("order"), F.concat(F.lit(rf"(?<![{_WORD}])"), pattern, F.lit(rf"(?![{_WORD}])")).alias("pattern"), put.alias("put"))

    def quoted(c: Column) -> Column:
        return F.concat(F.lit(r"\Q"), F.array_join(F.split(c, " "), r"\E[ \t]+\Q"), F.lit(r"\E"))

    whole = F.substring("canon", 3, 999)
    of_full = full.select("row", "canon").distinct().join(made, "canon")
    of_full = of_full.select("row", F.inline(F.array(rule(0, quoted(F.upper(whole)), F.upper("made")), rule(1, F.concat(F.lit("(?iu)"), quoted(whole)), F.col("made")))))
    bare = first.groupBy("row", "family").agg(F.min_by("short_made", "at").alias("put")).filter(F.length("family") > 1)
    mixed = F.concat(F.upper(F.substring("family", 1, 1)), F.lit(r"(?iu:\Q"), F.expr("substring(family, 2)"), F.lit(r"\E)"))
    of_family = bare.select("row", F.inline(F.array(rule(2, quoted(F.upper("family")), F.upper("put")), rule(3, mixed, F.col("put")))))
    rules = of_full.union(of_family).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("order", "pattern", "put"))).alias("rules"))
    return short, rules


def anonymized(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text with surrogates, n_entities, kinds per row.

    Null text stays null and has no entities; numbers that fail their check digit stay. Rows that
    repeat or lack an id are rows of their own. The same key gives the same surrogates, except where
    other entities of the corpus collide with them. Names that a text has with a title are followed
    through it without one; n_entities counts what a pattern finds. Texts of any length are taken
    whole, other columns are ignored, and an empty table gives an empty one.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("row", F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit(""))), 256))
    found = rows.select("row", F.regexp_extract_all("text", F.lit(PATTERN), 0).alias("m")).filter(F.size("m") > 0)
    found = saved(found.select("row", F.posexplode("m").alias("at", "entity")).distinct())
    kinds = found.select("entity").distinct().withColumn("kind", kind_of(F.col("entity"))).filter("kind IS NOT NULL")
    kinds = saved(kinds.withColumn("canon", canonical(F.col("kind"), F.col("entity"))))
    made = drawn(kinds.select("kind", "canon").distinct(), key)
    spelled = kinds.join(made, ["kind", "canon"]).select("entity", "kind", "canon", laid_over(F.col("kind"), F.col("entity"), F.col("made")).alias("instead"))
    short, rules = _aliases(found, kinds, made)
    spots = found.join(spelled, "entity", "left").join(short, ["row", "canon"], "left")
    titled = F.concat(F.regexp_extract("entity", f"(?i)^({_TITLE})", 1), F.col("short_made"))
    put = F.coalesce(F.when(F.col("kind") == "name", titled), F.col("instead"), F.col("entity"))
    per = spots.select("row", F.struct("at", put.alias("put"), "kind").alias("spot")).groupBy("row").agg(F.array_sort(F.collect_list("spot")).alias("spots"))
    out = rows.join(per, "row", "left").join(rules, "row", "left")

    def followed(part: Column) -> Column:
        every = F.aggregate("rules", part, lambda t, r: F.regexp_replace(t, r["pattern"], r["put"]))
        return F.when(F.col("rules").isNull(), part).otherwise(every)

    # Only texts with an entity are taken apart.
    out = out.withColumn("parts", F.when(F.col("spots").isNotNull(), F.transform(F.split("text", PATTERN, -1), followed)))
    joined = F.concat(F.array_join(F.transform("spots", lambda s, i: F.concat(F.element_at("parts", i + 1), s["put"])), ""), F.element_at("parts", -1))
    hits = F.filter(F.col("spots.kind"), lambda k: k.isNotNull())
    return out.select(
        "doc_id", F.when(F.col("spots").isNull(), F.col("text")).otherwise(joined).alias("text"),
        F.coalesce(F.size(hits), F.lit(0)).cast("long").alias("n_entities"), F.coalesce(F.array_join(F.array_sort(F.array_distinct(hits)), ","), F.lit("")).alias("kinds"),
    )


def query(spark, sf_dir):
    return anonymized(table(spark, sf_dir, "documents"), "an example key")


SQL = None
