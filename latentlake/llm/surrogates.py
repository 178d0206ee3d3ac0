"""Operator 7: personal data replaced by surrogates, in DataFrame functions alone.

Detected entities (e-mail and IP addresses of both versions, international and common national phone numbers, card numbers of 15 and 16 digits,
account and social security numbers, secrets, and persons named with a title; a person without one is not found) are replaced by keyed surrogates of the same type: digits stand for digits, letters for letters of their script and case, separators stay; a card
number that passes the Luhn check gets one that does; country codes and top-level domains stay; a person keeps title and gender.

Forms of one entity share a surrogate: numbers are told apart by their digits, addresses and secrets without regard to case, names word by
word, domains on their own. Surrogates are distinct: candidates are drawn per distinct entity, and those that another entity has drawn, or that
occur as real entities, are drawn again until none is left. Same key, same corpus, same result.

Texts are read twice, for detection and for replacement; between them only entities move.

Defined cases: null texts stay null, texts without entities stay as they are; rows with one doc_id and text get one result each; a null doc_id is
kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import query, read, settle, typed

KEY = "surrogate-key"
#: Texts with entities up to which their replacements are broadcast; beyond, the join shuffles.
FEW_TEXTS, FEW_ENTITIES = 100_000, 1_000_000
ATTEMPTS = 40

MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mademoiselle", "Señora", "Sra")
NEUTRAL = ("Dr", "Prof")
_TITLE = "|".join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True))
_EDGE = r"(?<![\p{L}\p{N}])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Kinds in the order in which they are tried; none needs more than a bounded look ahead from its first character.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]{1,64}@(?:[\p{L}\p{N}\-]{1,63}\.){1,8}\p{L}{2,24}",
    "ip": rf"(?<![\p{{L}}\p{{N}}.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\p{{L}}\p{{N}}]|\.\d)",
    "iban": _EDGE + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "secret": _EDGE + r"(?=[a-fA-F]{0,63}\d)[0-9a-fA-F]{32,128}(?![\p{L}\p{N}])",
    "ipv6": r"(?<![\p{L}\p{N}:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){2,6})(?![\p{L}\p{N}:])",
    "phone": r"(?<![\p{L}\p{N}+])\+\d{1,3}(?:[ .\-]?\(?\d{2,4}\)?[ .\-]?\d{3,4}[ .\-]?\d{3,4}|(?: ?\d{1,3})(?: \d{2,3}){3,4})(?![\p{L}\p{N}])",
    "card": _EDGE + r"(?:\d{4}(?:[ \-]?\d{4}){3}|3[47]\d{2}[ \-]?\d{6}[ \-]?\d{5})(?![\p{L}\p{N}])",
    "national": r"(?<![\p{L}\p{N}+\-])(?:\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4}|0\d(?:[ .]\d{2}){4}|0\d{1,4}[ /\-]\d{5,8})(?![\p{L}\p{N}]|-\d)",
    "ssn": _EDGE + r"\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}])",
    "person": _EDGE + rf"(?:{_TITLE})\.? \p{{Lu}}\p{{L}}{{1,30}}(?: \p{{Lu}}\p{{L}}{{1,30}})?(?![\p{{L}}\p{{N}}])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every entity contains.
SIGN = rf"[0-9@]|{_EDGE}(?:{_TITLE})\.? \p{{Lu}}"

#: Alphabets by script, lower and upper case side by side; letters outside them are drawn from RANGES.
ALPHABETS = (
    ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("àáâãäåçèéêëìíîïñòóôõöùúûüý", "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"),
    ("абвгдежзийклмнопрстуфхцчшщыэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЫЭЮЯ"),
    ("αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
    ("աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցւփքօֆ", "ԱԲԳԴԵԶԷԸԹԺԻԼԽԾԿՀՁՂՃՄՅՆՇՈՉՊՋՌՍՎՏՐՑՒՓՔՕՖ"),
)
#: First and last code point of runs of letters without case: Hebrew, Arabic, Devanagari, Thai, Georgian, kana, Chinese characters, Hangul.
RANGES = ((0x5D0, 0x5EA), (0x621, 0x63A), (0x905, 0x939), (0xE01, 0xE2E), (0x10D0, 0x10F0), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))
_LOW = "".join(a for a, _ in ALPHABETS)
_HIGH = "".join(b for _, b in ALPHABETS)
GIVEN = {
    "m": "Adam Anton Bruno Carl David Emil Felix Georg Hugo Ivan Jakob Karl Leon Martin Nils Oskar Paul Robert Simon Tomas Viktor Walter".split(),
    "f": "Anna Berta Clara Diana Elena Flora Greta Helena Irma Julia Klara Laura Maria Nora Olga Paula Rosa Sofia Tina Vera Wanda Zora".split(),
    "n": "Alex Andrea Kim Robin Sascha Toni Jules Noel Sam Charlie Jamie Luca Marion Dominique Camille Claude".split(),
}
SYLLABLES = "ba be bo da de do fa fe fo ga go ha he ka ke ko la le lo ma me mo na ne no pa pe po ra re ro sa se so ta te to va ve vo wa we".split()
ENDINGS = "berg dal feld ler mann ner rell rini rosa sen ski son stad tan thal ton vist wald".split()


def _draw(seed: Column, at: Column, n: int | Column) -> Column:
    """A number below ``n`` for place ``at`` of a keyed stream."""
    return F.pmod(F.xxhash64(seed, at.cast("int")), F.lit(n) if isinstance(n, int) else n).cast("int")


def _one_of(words, seed: Column, at: int) -> Column:
    return F.element_at(F.array(*(F.lit(w) for w in words)), _draw(seed, F.lit(at), len(words)) + 1)


def _swap(c: Column, seed: Column, at: Column) -> Column:
    """A lower-case letter or digit of the kind of ``c``; a letter of no known script gives a Latin one, other characters stay."""
    out = F.when((c >= "0") & (c <= "9"), _draw(seed, at, 10).cast("string"))
    for low, _ in ALPHABETS:
        out = out.when(F.position(c, F.lit(low)) > 0, F.substring(F.lit(low), _draw(seed, at, len(low)) + 1, F.lit(1)))
    point = F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("long")
    for first, last in RANGES:
        drawn = F.lpad(F.hex((first + _draw(seed, at, last - first + 1)).cast("long")), 4, "0")
        out = out.when((point >= first) & (point <= last), F.decode(F.unhex(drawn), "UTF-16BE"))
    latin = ALPHABETS[0][0]
    return out.when(c.rlike(r"^\p{L}$"), F.substring(F.lit(latin), _draw(seed, at, len(latin)) + 1, F.lit(1))).otherwise(c)


def _longer(seed: Column) -> Column:
    """Letters that make a surrogate longer once many of its own length were taken."""
    n = F.greatest(F.floor(F.col("attempt") / 4) - 2, F.lit(0)).cast("int")
    letters = F.transform(F.sequence(F.lit(0), n), lambda i: F.when(i > 0, F.substring(F.lit(ALPHABETS[0][0]), _draw(seed, 1000 + i, 26) + 1, F.lit(1))).otherwise(""))
    return F.array_join(letters, "")


def _swapped(text: Column, seed: Column) -> Column:
    n = F.length(text)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(places, lambda i: _swap(F.substring(text, i, F.lit(1)), seed, i)), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits, its last one included."""
    n = F.length(digits)
    d = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    doubled = lambda x: F.when(x > 9, x - 9).otherwise(x)
    parts = F.transform(F.sequence(F.lit(1), n), lambda i: F.when((n - i) % 2 == 1, doubled(d(i) * 2)).otherwise(d(i)))
    return F.aggregate(parts, F.lit(0), lambda acc, x: acc + x)


def candidates(units: DataFrame, key: str) -> DataFrame:
    """``units`` (kind, canon, attempt) with a drawn surrogate in canonical form."""
    canon = F.col("canon")
    # a digest of both halves of the key and the unit, so that streams cannot be told from one another without the key
    seed = F.sha2(F.concat_ws("|", F.lit(key), "kind", "canon", F.col("attempt").cast("string")), 256)
    domain = F.substring_index(canon, "@", -1)
    domain_seed = F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), domain), 256)
    top = F.substring_index(domain, ".", -1)
    labels = F.substring(domain, F.lit(1), F.length(domain) - F.length(top))
    email = F.concat(_swapped(F.substring_index(canon, "@", 1), seed), _longer(seed), F.lit("@"), _swapped(labels, domain_seed), top)
    ip = F.concat_ws(".", *(( _draw(seed, F.lit(i), 223 if i == 1 else 256) + (1 if i == 1 else 0)).cast("string") for i in range(1, 5)))
    # as many hexadecimal digits as there were, colons where they were
    groups = F.array_join(
        F.transform(F.sequence(F.lit(1), F.length(canon)), lambda i: F.when(F.substring(canon, i, F.lit(1)) == ":", ":").otherwise(F.lower(F.hex(_draw(seed, i, 16).cast("long"))))), ""
    )
    code = F.concat(F.substring_index(canon, "|", 1), F.lit("|"))
    phone = F.concat(code, _swapped(F.substring_index(canon, "|", -1), seed))
    card = _swapped(canon, seed)
    body = F.substring(card, F.lit(1), F.length(card) - 1)
    check = F.pmod(10 - _luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string")
    card = F.when(_luhn_sum(canon) % 10 == 0, F.concat(body, check)).otherwise(card)
    iban = F.concat(F.substring(canon, 1, 2), _swapped(F.substring(canon, F.lit(3), F.length(canon)), seed))
    hexes = F.array_join(
        F.transform(F.sequence(F.lit(1), F.length(canon)), lambda i: F.lower(F.hex(_draw(seed, i, 16).cast("long")))), ""
    )
    more = F.array_join(F.transform(F.sequence(F.lit(3), F.lit(3) + F.floor(F.col("attempt") / 4).cast("int")), lambda i: F.element_at(F.array(*(F.lit(s) for s in SYLLABLES)), _draw(seed, i, len(SYLLABLES)) + 1)), "")
    surname = F.lower(F.concat(_one_of(SYLLABLES, seed, 1), more, _one_of(ENDINGS, seed, 2)))
    tail = F.when(F.col("attempt") > 2, more).otherwise("")
    given = F.lit(None).cast("string")
    for g, names in GIVEN.items():
        given = F.when(F.col("kind") == f"given_{g}", F.lower(F.concat(F.when(F.col("attempt") > 2, tail).otherwise(""), _one_of(names, seed, 1)))).otherwise(given)
    latin = canon.rlike(r"^[a-zß-ÿ]*$")
    surrogate = (
        F.when(F.col("kind") == "email", email).when(F.col("kind") == "ip", ip).when(F.col("kind") == "phone", phone).when(F.col("kind") == "card", card)
        .when(F.col("kind") == "iban", iban).when(F.col("kind") == "secret", hexes).when(F.col("kind") == "surname", F.when(latin, surname).otherwise(F.concat(_swapped(canon, seed), _longer(seed))))
        .when(F.col("kind").startswith("given"), F.when(latin, given).otherwise(F.concat(_swapped(canon, seed), _longer(seed)))).when(F.col("kind") == "ipv6", groups).otherwise(_swapped(canon, seed))
    )
    return units.withColumn("surrogate", surrogate)


def distinct_surrogates(units: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, canon, surrogate) for distinct ``units`` (kind, canon): no two of a kind share one, and none is a real unit of its kind.

    Each round keeps, of the units that drew one surrogate, the least, and draws again for the rest.
    """
    pending, kept = units.withColumn("attempt", F.lit(0)), None
    real = units.select("kind", F.col("canon").alias("surrogate"))
    for attempt in range(ATTEMPTS):
        drawn = settle(candidates(pending, key).select("kind", "canon", "surrogate"))
        free = drawn.join(real, ["kind", "surrogate"], "left_anti")
        if kept is not None:
            free = free.join(kept.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = settle(free.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon")).select("kind", "canon", "surrogate"))
        lost = drawn.join(won.select("kind", "canon"), ["kind", "canon"], "left_anti").select("kind", "canon", F.lit(attempt + 1).alias("attempt"))
        kept = won if kept is None else kept.unionByName(won)
        pending = settle(lost)
        if pending.isEmpty():
            return settle(kept)
    raise RuntimeError("no free surrogates left; use longer ones for the kinds concerned")


def kind_of(entity: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def _gender(entity: Column) -> Column:
    title = F.regexp_replace(F.substring_index(entity, " ", 1), r"\.", "")
    return F.when(title.isin(*MALE), "m").when(title.isin(*FEMALE), "f").otherwise("n")


def _units(entity: Column, kind: Column) -> Column:
    """The units of an entity in order: (kind, canonical form)."""
    unit = lambda k, c: F.struct(k.alias("kind") if isinstance(k, Column) else F.lit(k).alias("kind"), c.alias("canon"))
    digits = F.regexp_replace(entity, r"\D", "")
    code = F.regexp_extract(entity, r"^\+(\d{1,3})", 1)
    code = F.when(F.length(code) > 0, code).otherwise("")
    phone = F.concat(code, F.lit("|"), F.substring(digits, F.length(code) + 1, F.length(digits)))
    words = F.split(F.regexp_replace(entity, rf"^(?:{_TITLE})\.? ", ""), " ")
    surname = unit("surname", F.lower(F.element_at(words, -1)))
    given = unit(F.concat(F.lit("given_"), _gender(entity)), F.lower(F.element_at(words, 1)))
    canon = (
        F.when(kind.isin("email", "secret", "ipv6"), F.lower(entity)).when(kind == "phone", phone).when(kind.isin("card", "ssn", "national"), digits)
        .when(kind == "iban", F.lower(F.regexp_replace(entity, " ", ""))).otherwise(entity)
    )
    return F.when(kind == "person", F.when(F.size(words) > 1, F.array(given, surname)).otherwise(F.array(surname))).otherwise(F.array(unit(kind, canon)))


def _cased(c: Column, like: Column) -> Column:
    return F.when(F.lower(like) != like, F.translate(c, _LOW, _HIGH)).otherwise(c)


def _rendered(entity: Column, kind: Column, subs: Column) -> Column:
    """Surrogates in the written form of the entity: separators, letter case, title and spacing as they were."""
    sub = F.element_at(subs, 1)
    flat = F.regexp_replace(sub, r"\|", "")
    n = F.length(entity)
    spread = F.aggregate(
        F.sequence(F.lit(1), n),
        F.struct(F.lit("").alias("done"), F.lit(1).alias("next")),
        lambda acc, i: F.when(
            F.substring(entity, i, F.lit(1)).rlike(r"[\p{L}\p{N}]"),
            F.struct(F.concat(acc["done"], _cased(F.substring(flat, acc["next"], F.lit(1)), F.substring(entity, i, F.lit(1)))).alias("done"), (acc["next"] + 1).alias("next")),
        ).otherwise(F.struct(F.concat(acc["done"], F.substring(entity, i, F.lit(1))).alias("done"), acc["next"].alias("next"))),
    )["done"]
    same = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: _cased(F.substring(sub, i, F.lit(1)), F.substring(entity, i, F.lit(1)))), "")
    same = F.concat(same, F.substring(sub, n + 1, F.greatest(F.length(sub) - n, F.lit(0))))
    title = F.regexp_extract(entity, rf"^((?:{_TITLE})\.? )", 1)
    person = F.concat(title, F.array_join(F.transform(subs, lambda s: F.concat(F.translate(F.substring(s, 1, 1), _LOW, _HIGH), F.substring(s, F.lit(2), F.length(s)))), " "))
    return F.when(kind == "person", person).when(kind == "ip", sub).when(kind.isin("email", "secret", "ipv6"), same).otherwise(spread)


def pseudonymised(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, n_entities, text) with surrogates in place of entities."""
    rows = typed(docs, doc_id="long", text="string").withColumn("of", F.xxhash64("text"))
    found = settle(rows.where(F.col("text").rlike(SIGN)).select("doc_id", "of", F.regexp_extract_all("text", F.lit(ANY), 0).alias("entities")))
    found = found.where(F.size("entities") > 0).dropDuplicates(["doc_id", "of"])
    each = settle(found.select("doc_id", "of", F.posexplode("entities").alias("place", "entity")))
    forms = settle(each.groupBy("entity").agg(F.lit(1).alias("one")).select("entity", kind_of(F.col("entity")).alias("kind")))
    parts = settle(forms.select("entity", F.posexplode(_units(F.col("entity"), F.col("kind"))).alias("nth", "unit")).select("entity", "nth", "unit.kind", "unit.canon"))
    drawn = distinct_surrogates(parts.select("kind", "canon").distinct(), key)
    subs = parts.join(drawn, ["kind", "canon"]).groupBy("entity").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "surrogate"))), lambda x: x["surrogate"]).alias("subs"))
    table = settle(forms.join(subs, "entity").select("entity", _rendered(F.col("entity"), F.col("kind"), F.col("subs")).alias("shown")))
    side = F.broadcast(table) if table.count() <= FEW_ENTITIES else table
    shown = settle(
        each.join(side, "entity").groupBy("doc_id", "of").agg(F.sort_array(F.collect_list(F.struct("place", "shown"))).alias("s"))
        .select(F.col("doc_id").alias("d"), F.col("of").alias("o"), F.transform("s", lambda x: x["shown"]).alias("shown"))
    )
    small = shown.count() <= FEW_TEXTS
    joined = rows.join(F.broadcast(shown) if small else shown, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("of") == F.col("o")), "left")
    pieces = F.split("text", ANY, -1)
    woven = F.array_join(F.flatten(F.zip_with(pieces, F.col("shown"), lambda p, s: F.array(p, F.coalesce(s, F.lit(""))))), "")
    return joined.select("doc_id", F.coalesce(F.size("shown"), F.lit(0)).alias("n_entities"), F.when(F.col("shown").isNull(), F.col("text")).otherwise(woven).alias("text"))


@query("op7_surrogates")
def op7(spark, sf):
    return pseudonymised(read(spark, sf, "documents"))
