"""Surrogates for personal data (DataFrame operators only).

One pattern finds e-mail addresses, phone numbers, IP addresses, payment cards,
social security numbers, IBANs, access keys, passwords or tokens, and person
names of the lexicons below. A found value is replaced by a surrogate of the
same kind, drawn from a keyed hash of the value: the same value gets the same
surrogate wherever it occurs (coreference), digits stay digits and letters stay
letters of the same case, valid card numbers and IBANs stay valid, and a name
becomes a name of the same gender and script. Known first names and surnames are permuted
within their lists, so that "Smith" alone and "John Smith" agree.

Collision check: over the distinct values of all documents, a surrogate that
two values share, or that is itself a value of the corpus, is drawn again with
the next attempt number, until none is left; values of one surname, or of one
address in other case, are drawn again together. Redrawn surnames are made of
letters and redrawn addresses get more of them, one more with each attempt, so
that there is room for any number; if STALLED rounds in a row leave no fewer
collisions (more values than their shape can hold), the check raises. Where there
are no such values, documents aren't shuffled at all; else the few attempt
numbers are joined to the documents concerned.

Defined results: a null text stays null and has no entities; an empty table
gives no rows; repeated rows get equal results; columns other than text are
passed through, unless called n_entities or entity_kinds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._scratch import written

KEY = "sessionlake.surrogates.key"
DRAWN_A_TASK = 1000
STALLED = 8  #: rounds without fewer collisions, after which the check raises

# Lexicons of common names, by script and gender.
MALE = "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Steven Andrew Peter Hans Klaus Pierre Jean Carlos Miguel".split()
FEMALE = "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Sandra Ashley Emily Anna Ursula Ingrid Marie Claire Carmen Lucia".split()
SURNAMES = "Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Moore Jackson Martin Thompson White Harris Clark Lewis Walker Young Schmidt Dubois Garcia Lopez".split()
MALE_CYRILLIC = "Иван Алексей Дмитрий Сергей Андрей Николай Михаил Павел".split()
FEMALE_CYRILLIC = "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split()
SURNAMES_CYRILLIC = "Иванов Петров Сидоров Кузнецов Смирнов Попов Соколов Лебедев".split()
LATIN, CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя"

_LABEL = r'(?i:passwords?|passwd|pwd|tokens?|secrets?|api[_-]?key|access[_-]?key)'
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}+@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9\-])",
    "secret": rf'(?<=[=: "\'])(?=[A-Za-z0-9+/_\-]{{8}})(?<={_LABEL}[ ]{{0,2}}[=:][ ]{{0,2}}["\']?)[A-Za-z0-9+/_\-]{{8,}}+',
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "card": r"(?<![\d\-])(?:\d{4}[ \-]?){3}\d{4}(?![\d\-])|(?<![\d\-])3[47]\d{2}[ \-]?\d{6}[ \-]?\d{5}(?![\d\-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}(?!\d)|(?<![\w+\-.])\d{3}[ .\-]\d{3}[ .\-]\d{4}(?![\d\-])",
    "name": r"(?=[A-Z])(?<!\p{L})(?:" + "|".join(MALE + FEMALE) + r") [A-Z][a-z]{1,24}(?:-[A-Z][a-z]{1,24})?(?!\p{L})|(?=[\u0400-\u042F])(?<!\p{L})(?:" + "|".join(MALE_CYRILLIC + FEMALE_CYRILLIC) + r") \p{IsCyrillic}{2,24}(?!\p{L})|(?<=(?:Mr|Ms|Mrs|Dr)\. )[A-Z][a-z]{1,24}(?!\p{L})",
}
PATTERN = "|".join(f"(?:{x})" for x in KINDS.values())
_NAMES = r"(?=[A-Z\u0400-\u042F])(?<!\p{L})(?:" + "|".join(MALE + FEMALE + MALE_CYRILLIC + FEMALE_CYRILLIC) + ") "


def may_hold(text: Column) -> Column:
    """True for any text with an entity; far cheaper than the pattern."""
    titled = text.contains("Mr. ") | text.contains("Ms. ") | text.contains("Mrs. ") | text.contains("Dr. ")
    labelled = text.rlike("[=:]") & text.rlike(_LABEL)
    return text.rlike(r"\d") | text.contains("@") | text.contains("AKIA") | text.contains("ASIA") | labelled | titled | text.rlike(_NAMES)


def found(text: Column) -> Column:
    """All entities of a text, in order."""
    return F.when(may_hold(text), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def kind_of(e: Column) -> Column:
    digits = F.regexp_replace(e, r"\D", "")
    return (
        F.when(e.contains("@"), "email").when(e.rlike("^(?:AKIA|ASIA)[0-9A-Z]{16}$"), "key").when(e.rlike(f"^(?:{KINDS['ip']})$"), "ip")
        .when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(e.rlike(r"^[\d \-]+$") & F.length(digits).isin(15, 16), "card").when(e.rlike(r"^[+(]|^\d{3}[ .\-]\d{3}[ .\-]\d{4}$"), "phone")
        .when(e.rlike(r"^\p{Lu}\p{Ll}+(?:[ \-]\p{Lu}?\p{Ll}+){0,2}$") & ~e.rlike(r"\d") | e.rlike(r"^\p{IsCyrillic}+ \p{IsCyrillic}+$"), "name").when(e.rlike(r"^[A-Z]{2}\d{2}[ A-Z0-9]{11,}$"), "iban").otherwise("secret")
    )


def _shaped(value: Column, stream: Column, keep: int = 0, hexadecimal: bool = False) -> Column:
    """value with each digit and letter, but the first ``keep``, drawn anew from the hex ``stream``.

    The stream has 128 hex digits; longer values wrap round and mix in the place.
    """
    chars = F.split(value, "")

    def draw(c: Column, i: Column) -> Column:
        v = F.conv(F.substring(stream, 1, 128).substr((i * 2 % 120 + 1).cast("int"), F.lit(4)), 16, 10).cast("int") + i
        if hexadecimal:
            return F.when(c.rlike("[0-9a-f]"), F.lower(F.hex(v % 16))).when(c.rlike("[A-F]"), F.hex(v % 16)).otherwise(c)
        return (
            F.when(i < keep, c).when(c.rlike("[0-9]"), (v % 10).cast("string"))
            .when(c.rlike("[a-z]"), F.char(v % 26 + 97)).when(c.rlike("[A-Z]"), F.char(v % 26 + 65)).otherwise(c)
        )

    return F.array_join(F.transform(chars, draw), "")


def _luhn(digits: Column) -> Column:
    """Sum of the Luhn check, of a string of digits."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(d, F.lit(0), lambda a, x: a + x)


def _card(value: Column, stream: Column) -> Column:
    """A number of the same network digit; a valid one stays valid."""
    fresh = _shaped(value, stream, keep=1)
    digits = F.regexp_replace(fresh, r"\D", "")
    need = (F.lit(10) - _luhn(F.concat(digits.substr(F.lit(1), F.length(digits) - 1), F.lit("0"))) % 10) % 10
    valid = _luhn(F.regexp_replace(value, r"\D", "")) % 10 == 0
    return F.when(valid, F.concat(fresh.substr(F.lit(1), F.length(fresh) - 1), need.cast("string"))).otherwise(fresh)


def _mod97(iban: Column) -> Column:
    """Remainder of the IBAN check, of a string of capitals and digits."""
    def step(acc: Column, c: Column) -> Column:
        v = F.ascii(c)
        return F.when(v >= 65, (acc * 100 + v - 55) % 97).otherwise((acc * 10 + v - 48) % 97).cast("int")

    moved = F.concat(iban.substr(F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    return F.aggregate(F.split(moved, ""), F.lit(0), step)


def _iban(value: Column, stream: Column) -> Column:
    """One of the same country and layout; a valid one stays valid."""
    fresh, bare = _shaped(value, stream, keep=2), lambda c: F.replace(c, F.lit(" "), F.lit(""))
    open_ = F.concat(F.substring(fresh, 1, 2), F.lit("00"), fresh.substr(F.lit(5), F.length(fresh)))
    digits = F.lpad((F.lit(98) - _mod97(bare(open_))).cast("string"), 2, "0")
    return F.when(_mod97(bare(value)) == 1, F.concat(F.substring(fresh, 1, 2), digits, fresh.substr(F.lit(5), F.length(fresh)))).otherwise(fresh)


def _permuted(word: Column, names: list[str], key: str) -> Column:
    """The name that a keyed rotation of the list puts in word's place; null if it isn't there."""
    at = F.array_position(F.array(*map(F.lit, names)), word)
    turn = F.pmod(F.xxhash64(F.lit(key), F.lit(names[0])), F.lit(len(names) - 1)) + 1
    return F.when(at > 0, F.element_at(F.array(*map(F.lit, names)), ((at - 1 + turn) % len(names) + 1).cast("int")))


def _letters(n: Column, stream: Column, alphabet: str) -> Column:
    """n letters (at most 25) drawn from the hex ``stream``."""
    letters = F.array(*map(F.lit, alphabet))
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(letters, (F.conv(stream.substr((i * 5 - 4).cast("int"), F.lit(5)), 16, 10).cast("int") % len(alphabet) + 1).cast("int"))), "")


def _surname(word: Column, stream: Column, key: str, attempt: Column) -> Column:
    known = _permuted(word, SURNAMES, key)
    russian = F.coalesce(_permuted(word, SURNAMES_CYRILLIC, key), F.concat(_permuted(F.regexp_replace(word, "а$", ""), SURNAMES_CYRILLIC, key), F.lit("а")))
    n = F.conv(F.substring(stream, 1, 7), 16, 10).cast("int")
    made = F.element_at(F.array(*map(F.lit, SURNAMES_CYRILLIC)), (n % len(SURNAMES_CYRILLIC) + 1).cast("int"))
    other = F.when(word.rlike(r"^\p{IsCyrillic}"), F.concat(made, F.when(word.rlike("[ая]$"), "а").otherwise(""))).otherwise(_shaped(word, stream))
    n_letters = F.least(attempt + 5, F.lit(23))
    fresh = F.when(word.rlike(r"^\p{IsCyrillic}"), F.concat(F.initcap(_letters(n_letters, stream, CYRILLIC)), F.when(word.rlike("[аяАЯ]$"), "а").otherwise(""))).otherwise(F.initcap(_letters(n_letters, stream, LATIN)))
    return F.when(attempt > 0, fresh).otherwise(F.coalesce(known, russian, other))


def _drawn_with(value: Column) -> Column:
    """What values that are drawn again together have in common."""
    kind = kind_of(value)
    return F.when(kind == "email", F.concat(F.lit("email|"), F.lower(value))).when(kind == "name", F.concat(F.lit("name|"), F.substring_index(value, " ", -1))).otherwise(F.concat(F.lit("|"), value))


def surrogate(value: Column, attempt: Column, key: str) -> Column:
    """The replacement of one entity; ``attempt`` counts redraws."""
    kind = kind_of(value)
    canonical = F.when(kind == "email", F.lower(value)).otherwise(value)

    def stream(of: Column) -> Column:
        return F.sha2(F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), of), 512)

    s = stream(canonical)
    octets = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.conv(s.substr((i * 8 + 1).cast("int"), F.lit(6)), 16, 10).cast("int") % 254 + 1).cast("string"))
    local, domain = F.substring_index(value, "@", 1), F.substring_index(canonical, "@", -1)
    longer = F.when(attempt > 0, _letters(F.least(attempt, F.lit(25)), F.sha2(s, 512), LATIN)).otherwise("")
    email = F.concat(_shaped(local, s), longer, F.lit("@"), _shaped(F.substring_index(domain, ".", 1), F.sha2(F.concat_ws("|", F.lit(key), domain), 512)), F.lit(".example.org"))
    first = F.substring_index(value, " ", 1)
    lists = (MALE, FEMALE, MALE_CYRILLIC, FEMALE_CYRILLIC)
    new_first = F.coalesce(*[_permuted(first, x, key) for x in lists])
    last = F.when(value.contains(" "), F.substring_index(value, " ", -1)).otherwise(value)
    new_last = _surname(last, stream(last), key, attempt)
    prefix = F.regexp_extract(value, r"^\+\d{1,3}(?=[ .\-(])", 0)
    phone = F.concat(prefix, _shaped(value.substr(F.length(prefix) + 1, F.length(value)), s))
    # a value with hardly a letter or digit to change: its signs become letters
    bare = (attempt > 0) & ~kind.isin("email", "name") & (F.length(F.regexp_replace(value, "[^A-Za-z0-9]", "")) < 6)
    return (
        F.when(bare, _shaped(F.regexp_replace(value, "[^A-Za-z0-9]", "x"), s)).when(kind == "email", email).when(kind == "ip", F.array_join(octets, ".")).when(kind == "card", _card(value, s)).when(kind == "phone", phone)
        .when(kind == "name", F.when(new_first.isNotNull() & value.contains(" "), F.concat(new_first, F.lit(" "), new_last)).otherwise(new_last))
        .when(kind == "key", _shaped(value, s, keep=4)).when(kind == "iban", _iban(value, s))
        .when(value.rlike("^[0-9a-f]+$") | value.rlike("^[0-9A-F]+$"), F.when(value.rlike("[a-f]"), _shaped(value, s, hexadecimal=True)).otherwise(F.upper(_shaped(F.lower(value), s, hexadecimal=True))))
        .otherwise(_shaped(value, s))
    )


def redraws(docs: DataFrame, key: str) -> DataFrame | None:
    """value, attempt for those values whose first surrogate collides; None if there are none."""
    values = docs.select(F.explode(F.array_distinct(found(F.col("text")))).alias("value")).distinct()
    values = written(values.withColumn("unit", _drawn_with(F.col("value"))), "pii-values")
    now, n, fewest, stalled = values.withColumn("attempt", F.lit(0)), 0, None, 0
    while True:
        # a surrogate costs far more than its row weighs, so tasks go by rows and not by bytes
        drawn = written(now.repartition(max(1, -(-now.count() // DRAWN_A_TASK)), "value").select("value", "unit", surrogate(F.col("value"), F.col("attempt"), key).alias("s")), "pii-drawn")
        first = drawn.groupBy("s").agg(F.min("unit").alias("owner"), F.max("unit").alias("other")).filter("owner < other")
        shared = drawn.join(first.select("s", "owner"), "s").filter(F.col("unit") != F.col("owner")).select("unit")
        real = drawn.join(values.select(F.col("value").alias("s")), "s", "left_semi").select("unit")
        again = written(shared.union(real).distinct(), "pii-again")
        left = again.count()
        if not left:
            break
        stalled = 0 if fewest is None or left < fewest else stalled + 1
        fewest = left if fewest is None else min(fewest, left)
        if stalled == STALLED:
            raise RuntimeError(f"redraws: {left} surrogates still collide")
        n += 1
        now = written(now.join(again.withColumn("more", F.lit(n)), "unit", "left").select("value", "unit", F.coalesce("more", "attempt").alias("attempt")), "pii-attempts")
    changed = now.filter(F.col("attempt") > 0).select("value", "attempt")
    return None if changed.isEmpty() else changed


def session_key(spark: SparkSession) -> str:
    """The session's secret (``sessionlake.surrogates.key``), without which surrogates can be guessed from their values."""
    return spark.conf.get(KEY, "surrogates")


def replace_entities(docs: DataFrame, key: str | None = None, check: bool = True) -> DataFrame:
    """docs with its entities replaced in ``text``, and n_entities, entity_kinds; ``key`` is the session's unless given."""
    key = session_key(docs.sparkSession) if key is None else key
    passed = [c for c in docs.columns if c not in ("text", "n_entities", "entity_kinds")]
    again = redraws(docs, key) if check else None
    # a generator of one row keeps the optimiser from repeating the search for every use of its result
    rows = docs.select(*passed, F.col("text"), F.explode(F.array(found(F.col("text")))).alias("entities"))
    if again is not None:
        text_key = F.md5("text")
        own = docs.select(text_key.alias("text_key"), F.explode(found(F.col("text"))).alias("value")).distinct().join(again, "value")
        maps = own.groupBy("text_key").agg(F.map_from_entries(F.collect_set(F.struct("value", "attempt"))).alias("attempts"))
        rows = rows.join(maps, F.md5(rows.text) == maps.text_key, "left").drop("text_key")
        attempt = lambda e: F.coalesce(F.element_at("attempts", e), F.lit(0))
    else:
        attempt = lambda e: F.lit(0)
    new = F.transform("entities", lambda e: surrogate(e, attempt(e), key))
    gaps = F.split("text", PATTERN, -1)
    text = F.when(F.size("entities") > 0, F.array_join(F.zip_with(gaps, new, lambda g, e: F.concat(F.coalesce(g, F.lit("")), F.coalesce(e, F.lit("")))), "")).otherwise(F.col("text"))
    kinds = F.array_sort(F.array_distinct(F.transform("entities", kind_of)))
    return rows.select(*passed, text.alias("text"), F.size("entities").cast("long").alias("n_entities"), kinds.alias("entity_kinds"))


def op10_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace_entities(docs).select("doc_id", "n_entities", F.array_join("entity_kinds", ",").alias("kinds"), "text")
