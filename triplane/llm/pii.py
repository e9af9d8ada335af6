"""PII: detected entities get surrogates that keep their type, format, script and gender.

An entity is read as one or more parts, each of a canonical value: an address without regard to case, the digits of a card
or telephone number, the given and family names of a person. A part's surrogate follows from a secret key, its kind and
that value, and the entity's own format (grouping, case, title) is laid over it, so whatever stands for one thing gets one
surrogate wherever and however it is written (coreference). The distinct parts of the corpus are checked: no two of a kind
may get the same surrogate, and none a value that the corpus itself holds. The few that collide are drawn again, round by
round, until none is left (distinctness). Everything is built of DataFrame expressions.
"""

from __future__ import annotations

from secrets import token_hex

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triplane.llm.common import durable, fresh, once, table, text_key

#: Types, in the order in which they win where several would match at one place.
TYPES = ("email", "card", "ip", "phone", "name")
# No group is repeated without a small bound or possessively: Java's matcher recurses for each other turn of a group, and a
# long text would overflow its stack.
_EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_%+-]++(?:\.[\p{L}\p{N}_%+-]++)*+@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){0,16}\.\p{L}{2,63}"
_CARD = r"(?<![0-9A-Za-z])(?:[3-6][0-9]{3}(?:[ -]?[0-9]{4}){3}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![0-9A-Za-z])"
_IP = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"
_PHONE = r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})|\([0-9]{3}\)|[0-9]{3}[.-](?=[0-9]{3}[.-]))[ .-]?[0-9]{3}[ .-]?[0-9]{2,4}(?:[ .-]?[0-9]{2,4})?(?![0-9A-Za-z])"
_WOMAN = "Mrs\\.?|Ms\\.?|Miss|Frau|Madame|Mme|Señora|Sra\\.|Госпожа|г-жа"
_MAN = "Mr\\.?|Herrn?|Monsieur|Señor|Sr\\.|Господин|г-н"
_EITHER = "Dr\\.?|Doctor|Doktor|Docteur|Prof\\.?|Professor|Доктор|Профессор"
_TITLE = rf"(?:{_WOMAN}|{_MAN}|{_EITHER})(?:\x20(?:Dr|Prof)\.)?"
_ONE = r"\p{Lu}\p{Ll}++(?:-\p{Lu}\p{Ll}++)?"
_NAME = rf"(?<!\p{{L}}){_TITLE}\x20{_ONE}(?:\x20{_ONE})?"
ANY = "|".join((_EMAIL, _CARD, _IP, _PHONE, _NAME))
#: The country code of an international number.
_COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{1,3})"

#: Given and family names for surrogates, by script and gender.
GIVEN = {
    ("latin", "f"): "Alice Anna Clara Diana Elena Emma Flora Greta Helena Irene Julia Karla Laura Maria Nora Olivia Paula Rosa Sara Vera".split(),
    ("latin", "m"): "Adam Bruno Carl David Emil Felix George Hugo Ivan Jonas Karl Leon Martin Nico Oscar Paul Robert Simon Thomas Victor".split(),
    ("latin", "n"): "Alex Andy Charlie Chris Dominique Eden Francis Jamie Jules Kim Kit Lee Lou Morgan Noa Robin Rowan Sascha Sidney Toni".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Клара Лидия Мария Нина Ольга Полина Раиса Софья".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Максим Николай Олег Павел Роман Семён".split(),
    ("cyrillic", "n"): "Валя Женя Саша Слава Шура".split(),
    ("greek", "f"): "Αννα Βασιλικη Ειρηνη Ελενη Ζωη Μαρια Σοφια Χριστινα".split(),
    ("greek", "m"): "Αλεξης Γιωργος Δημητρης Κωστας Νικος Πετρος Σπυρος Φωτης".split(),
    ("greek", "n"): "Φανης Βαγια Ρενα Τασος".split(),
}
_STEMS = {
    "latin": ("al ber car dal el fal gar hol il jan kel lan mar nor ol per quil ros sel tor ul ver wil yar zel bran clar dor fen grem hart kor".split(), "an ber den el fort gard holm ina ker land mann nes or per ris son ström tal ver wick".split()),
    "cyrillic": ("ал бор вас гор дем ер жар зим кар лар мар нов ор пав род сав тар фед чер яр".split(), "ан ел ир ол ум ын ав ев от ук".split()),
    "greek": ("αλ βασ γεωρ δημ θεο καρ λαμ μαρ νικ παπ σταυρ χρ".split(), "αν ελ ιν ορ ατ ακ ιδ ουλ".split()),
}
#: What ends a family name. In Cyrillic a woman's adds an а.
_ENDS = {"latin": [""], "cyrillic": ["ов", "ев", "ин"], "greek": ["ης", "ος", "ου"]}
_SCRIPTS = {"cyrillic": r"^\p{IsCyrillic}", "greek": r"^\p{IsGreek}"}
_FEMALE_FAMILY = r"(?:[оеё]в|[иы]н)а$"
#: Marks the family name of a woman that has no form of its own for her, so that it isn't taken for a man's.
_UNINFLECTED = "\x1f"
#: A round's surrogates are checked. From this round on addresses and numbers grow, as names do from the first, so that no
#: format runs out of values; internet addresses can't, but have 4 * 10 ** 9.
GROW_AFTER = 6
MOST_ROUNDS = 40
BROADCAST_ROWS = 200_000

_ALPHABETS = {"0123456789": r"[0-9]", "abcdefghijklmnopqrstuvwxyz": r"[a-z]", "абвгдежзиклмнопрстуфхцчшщэюя": r"\p{IsCyrillic}", "αβγδεζηθικλμνξοπρστυφχψω": r"\p{IsGreek}", "àâçèéêëîïôùûüñóíáúäö": r"\p{L}"}


def _number(seed: Column, i: Column | int, base: int) -> Column:
    """A number below ``base`` that a hex digest gives for place i."""
    at = (F.lit(i) if isinstance(i, int) else i) % 8
    block = F.conv(F.substring(seed, (at * 8 + 1).cast("int"), F.lit(8)), 16, 10).cast("long")
    return ((block + i * 7919) % 1000003 % base).cast("int")


def _pick(seed: Column, i: Column | int, values: list[str]) -> Column:
    return F.element_at(F.split(F.lit(" ".join(values)), " "), _number(seed, i, len(values)) + 1)


def _shaped(value: Column, seed: Column) -> Column:
    """``value`` (lower case) with each letter and digit replaced by one of its kind; all else stays."""

    def one(c: Column, i: Column) -> Column:
        out = c
        for kinds, rx in reversed(_ALPHABETS.items()):
            out = F.when(c.rlike(rx), F.substring(F.lit(kinds), _number(seed, i, len(kinds)) + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _digits(seed: Column, n: Column) -> Column:
    """n digits from 2 to 9, so that no group that they may be written in begins with 0 or 1."""
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (_number(seed, i, 8) + 2).cast("string")), "")).otherwise("")


def kind_of(value: Column) -> Column:
    full = lambda rx: value.rlike(f"^(?:{rx})$")
    return F.when(value.contains("@"), "email").when(full(_CARD), "card").when(full(_IP), "ip").when(value.rlike(rf"^{_TITLE}\x20"), "name").otherwise("phone")


def _gender(value: Column) -> Column:
    return F.when(value.rlike(rf"^(?:{_WOMAN})\x20"), "f").when(value.rlike(rf"^(?:{_MAN})\x20"), "m").otherwise("n")


def _person(value: Column) -> Column:
    """The names after the title: an array of one (the family name) or two."""
    return F.split(F.regexp_replace(value, rf"^{_TITLE}\x20", ""), " ")


def _family(name: Column, gender: Column) -> Column:
    """The canonical form of a family name; a woman's is the man's where it shows how."""
    lower = F.lower(name)
    female = lower.rlike(_FEMALE_FAMILY)
    woman = (gender == "f") & lower.rlike(_SCRIPTS["cyrillic"])
    return F.when(woman & female, F.regexp_replace(lower, "а$", "")).when(woman, F.concat(lower, F.lit(_UNINFLECTED))).otherwise(lower)


def parts_of(value: Column, kind: Column) -> Column:
    """The parts of an entity: an array of ``part, canonical``."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    numbers = F.array_join(F.transform(F.split(value, r"\."), lambda x: x.cast("int").cast("string")), ".")
    plain = F.when(kind == "email", F.lower(value)).when(kind == "ip", numbers).when(kind == "card", digits).otherwise(F.concat(F.when(value.startswith("+"), "+").otherwise(""), digits))
    gender, person = _gender(value), _person(value)
    part = lambda k, c: F.struct(k.alias("part"), c.alias("canonical"))
    last = F.size(person) - 1
    names = F.flatten(F.transform(person, lambda p, i: F.transform(F.split(p, "-"), lambda n: F.when(i == last, part(F.lit("family"), _family(n, gender))).otherwise(part(F.concat(F.lit("given_"), gender), F.lower(n))))))
    return F.when(kind == "name", names).otherwise(F.array(part(kind, plain)))


def _card(digits: Column, seed: Column) -> Column:
    """A card number that keeps the first digit (of 15 the first two) and the length; the last digit makes the Luhn sum whole."""
    kept = F.when(F.length(digits) == 15, F.lit(2)).otherwise(F.lit(1))
    body = F.concat(F.substring(digits, F.lit(1), kept), F.array_join(F.transform(F.sequence(F.lit(1), F.length(digits) - kept - 1), lambda i: _number(seed, i, 10).cast("string")), ""))
    doubled = lambda d: (d * 2) % 10 + F.floor(d / 5).cast("int")
    total = F.aggregate(F.transform(F.split(F.reverse(body), ""), lambda d, i: F.when(i % 2 == 0, doubled(d.cast("int"))).otherwise(d.cast("int"))), F.lit(0), lambda s, d: s + d)
    return F.concat(body, ((10 - total % 10) % 10).cast("string"))


def surrogate(canonical: Column, part: Column, attempt: Column, key: str) -> Column:
    """The replacement of a part, in canonical form: of the same kind, drawn by key, kind, value and attempt."""
    seed = F.sha2(F.concat_ws("\x1e", F.lit(key), part, canonical, attempt.cast("string"), F.lit(key)), 256)
    more = F.greatest(attempt - GROW_AFTER, F.lit(0))
    # An address keeps its top-level domain; local part and domain keep their separators and script.
    top = F.regexp_extract(canonical, r"\.[^.@]*$", 0)
    body = _shaped(F.substring(canonical, F.lit(1), F.length(canonical) - F.length(top)), seed)
    email = F.concat(F.substring_index(body, "@", 1), _shaped(F.repeat(F.lit("a"), more), F.sha2(seed, 256)), F.lit("@"), F.substring_index(body, "@", -1), top)
    ip = F.concat_ws(".", *(_number(seed, i, 254) + 1 for i in range(4)))
    country = F.regexp_extract(canonical, _COUNTRY, 0)
    phone = F.concat(country, _digits(seed, F.length(canonical) - F.length(country) + more))
    card = F.when(F.length(canonical) > 2, _card(canonical, seed))
    # Each further attempt adds a syllable, so that there are always more names than entities.
    syllable = lambda s, i: _pick(F.sha2(F.concat_ws("\x1e", seed, i.cast("string")), 256), 0, _STEMS[s][1])
    tail = lambda s: F.array_join(F.transform(F.sequence(F.lit(0), attempt), lambda i: F.when(i > 0, syllable(s, i)).otherwise("")), "")
    family = lambda s: F.concat(_pick(seed, 0, _STEMS[s][0]), _pick(seed, 1, _STEMS[s][1]), _pick(seed, 2, _STEMS[s][1]), tail(s), _pick(seed, 3, _ENDS[s]) if len(_ENDS[s]) > 1 else F.lit(_ENDS[s][0]))
    given = lambda s: F.concat(F.when(part == "given_f", _pick(seed, 4, [n.lower() for n in GIVEN[s, "f"]])).when(part == "given_m", _pick(seed, 4, [n.lower() for n in GIVEN[s, "m"]])).otherwise(_pick(seed, 4, [n.lower() for n in GIVEN[s, "n"]])), tail(s))
    scripted = lambda made: F.when(canonical.rlike(_SCRIPTS["cyrillic"]), made("cyrillic")).when(canonical.rlike(_SCRIPTS["greek"]), made("greek")).otherwise(made("latin"))
    return F.when(part == "email", email).when(part == "card", card).when(part == "ip", ip).when(part == "phone", phone).when(part == "family", scripted(family)).otherwise(scripted(given))


def assign(parts: DataFrame, key: str) -> DataFrame:
    """Rows ``part, canonical, surrogate`` for distinct ``part, canonical``, without two alike surrogates of a kind.

    Nor is a surrogate a value of the corpus. Of parts that collide the one least by value keeps what it drew.
    """
    drawn = lambda df: once(df, surrogate=surrogate(F.col("canonical"), F.col("part"), F.col("attempt"), key))
    table_ = durable(drawn(parts.withColumn("attempt", F.lit(0))))
    for attempt in range(1, MOST_ROUNDS + 1):
        held = table_.groupBy("part", "surrogate").agg(F.min(F.struct("attempt", "canonical")).alias("first"), F.count("*").alias("n"))
        real = table_.select("part", F.col("canonical").alias("surrogate"), F.lit(True).alias("real"))
        bad = held.join(real, ["part", "surrogate"], "left").where("n > 1 or real").select("part", "surrogate", F.when(F.col("real").isNull(), F.col("first.canonical")).alias("keeper"))
        bad = durable(bad)
        if bad.isEmpty():
            return table_.select("part", "canonical", "surrogate")
        marked = table_.join(bad.withColumn("hit", F.lit(True)), ["part", "surrogate"], "left")
        again = F.col("hit").isNotNull() & ~F.col("canonical").eqNullSafe(F.col("keeper"))
        redrawn = drawn(marked.where(again).select("part", "canonical", F.lit(attempt).alias("attempt")))
        table_ = durable(marked.where(~again).select("part", "canonical", "attempt", "surrogate").unionByName(redrawn))
    raise ValueError("more internet addresses than surrogates")


def _laid(value: Column, digits: Column) -> Column:
    """Digits in the grouping of ``value``; what is beyond its own number of digits follows at the end."""
    gaps, n = F.split(value, "[0-9]", -1), F.length(digits)
    filled = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.substring(digits, i + 1, F.lit(1)))), "")
    return F.concat(filled, F.when(n > F.size(gaps), F.substring(digits, F.size(gaps) + 1, n)).otherwise(""))


def render(value: Column, kind: Column, given: Column) -> Column:
    """An entity's surrogate: the surrogates of its parts (a map by ``part:canonical``) in the entity's format."""
    only = F.map_values(given)[0]
    at = F.instr(value, "@") - 1
    grown = F.length(only) - F.length(value)

    def cased(c: Column, i: Column) -> Column:
        source = F.when(i < at, i + 1).when(i < at + grown, 0).otherwise(i - grown + 1)
        return F.when((source > 0) & F.substring(value, source, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)

    email = F.array_join(F.transform(F.split(only, ""), cased), "")
    gender, person = _gender(value), _person(value)
    last = F.size(person) - 1

    def named(n: Column, i: Column) -> Column:
        family = _family(n, gender)
        name = F.when(i == last, given[F.concat(F.lit("family:"), family)]).otherwise(given[F.concat(F.lit("given_"), gender, F.lit(":"), F.lower(n))])
        female = (i == last) & (gender == "f") & F.lower(n).rlike(_SCRIPTS["cyrillic"])
        return F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.length(name)), F.when(female, "а").otherwise(""))

    names = F.array_join(F.transform(person, lambda p, i: F.array_join(F.transform(F.split(p, "-"), lambda n: named(n, i)), "-")), " ")
    name = F.concat(F.regexp_extract(value, rf"^{_TITLE}\x20", 0), names)
    return F.when(kind == "email", email).when(kind == "ip", only).when(kind == "name", name).otherwise(_laid(value, F.regexp_replace(only, "[^0-9]", "")))


def replace(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with entities in ``text`` replaced, and ``entities`` added: an array of ``kind, value, surrogate`` in order.

    ``key`` is secret: who has it can tell which surrogate a guessed value gets. A null text stays null and an empty one
    empty, without entities; texts are taken whole, however long; all rows stay, and equal texts get equal replacements. An
    empty table stays empty. A column ``entities`` is replaced.
    """
    docs = docs.drop("entities")
    a, b = text_key(F.col("text"))
    ka, kb, vs, mp = (fresh(docs, x) for x in ("_ka", "_kb", "_values", "_map"))
    values = F.regexp_extract_all("text", F.lit(ANY), F.lit(0))
    seen = durable(once(docs.where(F.col("text").isNotNull()).select("text"), values=values).where(F.size("values") > 0).select(*text_key(F.col("text")), "values").distinct())
    listed = seen.select("key_a", "key_b", F.posexplode("values").alias("at", "value"))
    entities = once(listed.select("value").distinct(), kind=kind_of(F.col("value")))
    entities = durable(once(entities, parts=parts_of(F.col("value"), F.col("kind"))))
    each = entities.select("value", F.explode("parts").alias("x")).select("value", "x.part", "x.canonical")
    assigned = assign(each.select("part", "canonical").distinct(), key)
    drawn = each.join(assigned, ["part", "canonical"]).groupBy("value").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws(":", "part", "canonical"), "surrogate"))).alias("given"))  # a few parts each
    given = durable(once(entities.join(drawn, "value"), surrogate=render(F.col("value"), F.col("kind"), F.col("given"))).select("value", "kind", "surrogate"))
    fit = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df
    mapped = listed.join(fit(given, given.count()), "value").groupBy("key_a", "key_b").agg(F.array_sort(F.collect_list(F.struct("at", "kind", "value", "surrogate"))).alias("entities"))
    mapped = durable(mapped).toDF(ka, kb, mp)
    rows = seen.agg(F.coalesce(F.sum(F.size("values")), F.lit(0))).first()[0]
    out = docs.join(fit(mapped, rows), (a == F.col(ka)) & (b == F.col(kb)), "left").drop(ka, kb)
    gaps = F.split("text", ANY, -1)
    filled = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(F.col(mp), i)["surrogate"], F.lit("")))), "")
    out = once(out, **{vs: F.when(F.col(mp).isNotNull(), filled).otherwise(F.col("text"))})
    kind = "array<struct<kind:string,value:string,surrogate:string>>"
    told = F.coalesce(F.transform(F.col(mp), lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"), x["surrogate"].alias("surrogate"))), F.array().cast(kind))
    return out.withColumns({"entities": told, "text": F.col(vs)}).drop(vs, mp)


def secret_key(spark: SparkSession) -> str:
    """The session's ``spark.triplane.pii.secretkey``; where it is unset a new random one, which is kept nowhere."""
    return spark.conf.get("spark.triplane.pii.secretkey", None) or token_hex(32)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its text with surrogates, and the number of entities of each type."""
    found = replace(table(spark, sf_dir, "documents").select("doc_id", "text"), secret_key(spark))
    count = lambda kind: F.size(F.filter("entities", lambda e: e["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", "text", *(count(k) for k in TYPES), F.size("entities").cast("long").alias("n_entities"))
