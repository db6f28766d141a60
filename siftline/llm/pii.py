"""Personal data replaced by keyed surrogates, with DataFrame functions only.

Addresses and numbers pass through a keyed Feistel network over their own characters: digits stay digits,
letters stay letters of their case and script, separators stay. For one key that is a permutation of all
entities of a shape, so one entity has one surrogate everywhere and two never share one, without any lookup.
A name is a title, given names and a surname. Each word has a surrogate of its own, so a person keeps one under
every title and a family its surname. For Latin and Cyrillic they come from lists, given names by gender, and two
may meet; words of other scripts pass through the network. Addresses that stay in the way tweak after tweak, as all of a short shape may be taken, grow. A check over all distinct entities of the table
finds surrogates that two share, or that are entities themselves; these take the next tweak of the key, until
none is left. The few entities with a tweak are then known to every row.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections import defaultdict
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch_scope

ROUNDS = 4
#: Up to so many tweaked entities travel with the plan; more are joined to the texts that hold them.
TWEAKED = 10_000

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Honorifics by gender ("" where it is unknown).
HONORIFICS = {"f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra"], "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr"], "": ["Dr", "Prof"]}
#: Endings of given names that count as feminine where no title tells.
FEMININE = "(?:a|ie|ine|ette|elle|а|я|α|η)$"
TITLE = rf"(?:{'|'.join(x for xs in HONORIFICS.values() for x in xs)})\.?"
#: In order of precedence at one place; the first that matches a whole entity is its type. Lengths are bounded as by the standards for addresses, as each turn of a group takes stack.
TYPES = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@(?:[\p{L}\p{N}-]{1,63}+\.){1,126}\p{L}{2,63}+",
    "phone": r"(?<![\p{L}\p{N}+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![\p{L}\p{N}])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![\p{L}\p{N}.-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])",
    "ssn": r"(?<![\p{L}\p{N}.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": rf"(?<![\p{{L}}\p{{N}}.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])",
    "card": r"(?<![\p{L}\p{N}])(?:[0-9]{13,19}|(?:[0-9]{4}[ -]){3}[0-9]{4})(?![\p{L}\p{N}])",
    "name": rf"(?<!\p{{L}}){TITLE} \p{{Lu}}\p{{Ll}}{{1,63}}+(?:[ -]\p{{Lu}}\p{{Ll}}{{1,63}}+){{0,2}}(?!\p{{L}})",
}
ANY = "|".join(f"(?:{p})" for p in TYPES.values())
#: A text without any of these holds no entity.
HINT = rf"@|[0-9]{{2}}|[0-9]\.[0-9]|{TITLE} \p{{Lu}}"

#: Characters that may stand for each other.
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "àáâäåæçèéêëìíîïñòóôöùúûü", "абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"]
#: Ideographs and Hangul syllables, by code point.
RANGES = [(0x4E00, 0x9FFC), (0xAC00, 0xD7A3), (0x3400, 0x4DBF), (0x20000, 0x2A6DD), (0x2A700, 0x2B734), (0x2B740, 0x2B81D), (0x2B820, 0x2CEA1), (0x2CEB0, 0x2EBE0), (0x30000, 0x3134A)]
#: Every fourth tweak makes an address longer by a character.
GROWS = 4


def other_letters() -> tuple[str, list[int]]:
    """All other letters and numbers, alphabet after alphabet, and where (from 1) each starts, with the end.

    An alphabet is of one script, one category, and of letters that come back from upper case or not. What
    Unicode 3.2 does not know has alphabets of its own, so that later versions leave the others as they are.
    """
    alphabets: dict[tuple, list[str]] = defaultdict(list)
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        category = unicodedata.category(c)
        if category[0] not in "LN" or any(c in x for x in ALPHABETS) or any(a <= ord(c) <= b for a, b in RANGES):
            continue
        script = unicodedata.name(c, "").replace("-", " ").split(" ")[0]
        old = unicodedata.ucd_3_2_0.category(c) != "Cn"
        alphabets[not old, script, category, c.upper() != c and len(c.upper()) == 1 and c.upper().lower() == c].append(c)
    # What is alone in its alphabet forms one with the others that are.
    alone = [x[0] for x in alphabets.values() if len(x) == 1]
    several = [x for _, x in sorted(alphabets.items(), key=lambda kv: (kv[0][0], kv[1][0])) if len(x) > 1] + [alone]
    starts = [1]
    for x in several:
        starts.append(starts[-1] + len(x))
    return "".join(c for x in several for c in x), starts


LETTERS, STARTS = other_letters()
#: Names by script, given names by gender.
NAMES = {
    "latin": {
        "f": "Alma Bettina Clara Dora Elena Flora Greta Hanna Irma Julia Karla Lena Marta Nora Olivia Paula Rosa Sofia Tilda Vera".split(),
        "m": "Anton Bruno Carlos David Emil Felix Georg Hugo Ivan Jonas Karl Leo Martin Nils Oscar Paul Robert Simon Thomas Victor".split(),
        "last": "Adler Berger Castro Duval Engel Fischer Garnier Hansen Iversen Jansen Keller Lambert Moreau Norton Ortega Parker Quinn Romero Sutter Tanner Ullman Vargas Weber Zeller".split(),
    },
    "cyrillic": {
        "f": "Анна Вера Галина Дарья Елена Жанна Ирина Ксения Лидия Мария Нина Ольга Полина Раиса Софья Тамара".split(),
        "m": "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Леонид Максим Николай Олег Павел Роман Семён Тимур".split(),
        "last": "Белых Власенко Гончаренко Дубинин Ершов Жуков Зимин Ильин Котов Лапин Мельник Носов Орлов Панин Рыбак Седых".split(),
    },
}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once, also within a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def kind_of(entity: Column) -> Column:
    """The type of an entity found by ANY, matched whole."""
    whole = {k: rf"^(?:{p})$" for k, p in TYPES.items()}
    return reduce(lambda rest, k: F.when(entity.rlike(whole[k]), F.lit(k)).otherwise(rest), reversed(whole), F.lit("name"))


def core_of(kind: Column, entity: Column) -> Column:
    """What makes two mentions one entity: case, separators and honorifics aside."""
    digits = F.regexp_replace(entity, "[^0-9+]", "")
    octets = F.array_join(F.transform(F.split(entity, r"\."), lambda o: o.cast("int").cast("string")), ".")
    return F.when(kind == "email", F.lower(entity)).when(kind == "ip", octets).when(kind == "name", F.regexp_replace(entity, rf"^{TITLE} ", "")).otherwise(digits)


def parts_of(kind: Column, entity: Column, core: Column) -> Column:
    """Array of (kind, core) of what has a surrogate of its own: the words of a name, else the entity. Given names carry a gender, by the title or else by their ending."""
    titled = reduce(lambda rest, g: F.when(entity.rlike(rf"^(?:{'|'.join(HONORIFICS[g])})\.? "), F.lit(g)).otherwise(rest), ("f", "m"), F.lit(""))

    def words(own: Column) -> Column:
        gender = lambda w: F.when(titled != "", titled).when(w.rlike(FEMININE), F.lit("f")).otherwise(F.lit("m"))
        given = lambda w: F.struct(F.lit("given").alias("kind"), F.concat(gender(w), F.lit("|"), w).alias("core"))
        last = lambda w: F.struct(F.lit("last").alias("kind"), F.concat(F.lit("|"), w).alias("core"))
        return F.transform(own, lambda w, i: F.when(i < F.size(own) - 1, given(w)).otherwise(last(w)))

    return F.when(kind == "name", let(F.split(core, " "), words)).otherwise(F.array(F.struct(kind.alias("kind"), core.alias("core"))))


def stream(key: Column, salt: str, seed: Column) -> Column:
    return F.sha2(F.concat_ws("|", key, F.lit(salt), seed), 256)


def byte_at(hexed: Column, i: Column) -> Column:
    return F.conv(F.substring(hexed, F.pmod(i, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def moved_within(alphabet: str, at: Column, by: Column) -> Column:
    return F.substring(F.lit(alphabet), F.pmod(at - 1 + by, F.lit(len(alphabet))) + 1, F.lit(1))


def other_table() -> Column:
    """LETTERS and STARTS. They are long, so that a plan should hold them once."""
    return F.struct(F.lit(LETTERS).alias("letters"), F.from_json(F.lit(json.dumps(STARTS)), "array<int>").alias("starts"))


def moved_beyond(c: Column, by: Column, table: Column) -> Column:
    """A character of none of ALPHABETS moved within its own; what is no letter or number stays."""
    def moved(point: Column) -> Column:
        new = F.lit(None).cast("long")
        for a, b in RANGES:
            new = F.when(point.between(a, b), F.pmod(point - a + by, F.lit(b - a + 1)) + a).otherwise(new)
        elsewhere = let(F.instr(table["letters"], c), lambda at: F.when(at > 0, listed(at)).otherwise(c))
        return let(new, lambda n: F.when(n.isNull(), elsewhere).otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")))

    def listed(at: Column) -> Column:
        nth = F.size(F.filter(table["starts"], lambda s: s <= at))
        return let(nth, lambda n: let(F.element_at(table["starts"], n), lambda a: F.substring(table["letters"], (a + F.pmod(at - a + by, F.element_at(table["starts"], n + 1) - a)).cast("int"), F.lit(1))))

    return let(F.ascii(c).cast("long"), moved)


def shifted(text: Column, hexed: Column, table: Column | None) -> Column:
    """Each character moved along its alphabet by the stream's byte, or two where it may be long; without a table only digits."""
    def move(c: Column, i: Column, h: Column) -> Column:
        def listed(alphabets: list[str], rest: Column) -> Column:
            for x in reversed(alphabets):
                at = F.instr(F.lit(x), c)
                rest = F.when(at > 0, moved_within(x, at, byte_at(h, i))).otherwise(rest)
            return rest

        if table is None:
            return listed(ALPHABETS[:1], c)
        far = listed(ALPHABETS[2:], moved_beyond(c, byte_at(h, i) * 256 + byte_at(h, i + 1), table))
        return F.when(c < F.lit("\x80"), listed(ALPHABETS[:2], c)).otherwise(far)

    # The stream is worked out once, not for each character.
    return F.when(text == "", text).otherwise(let(hexed, lambda h: F.array_join(F.transform(F.split(text, ""), lambda c, i: move(c, i, h)), "")))


def permuted(text: Column, key: Column, salt: str, table: Column | None = None) -> Column:
    """A keyed permutation of the texts of one shape: a Feistel network over two halves."""
    half = F.floor(F.length(text) / 2).cast("int")
    # The half that moves next comes first, so that the expression holds shifted() once.
    state = F.struct(F.substring(text, F.lit(1), half).alias("a"), F.substring(text, half + 1, F.length(text)).alias("b"))

    def step(s: Column, turn: Column) -> Column:
        moved = shifted(s["a"], stream(key, salt, F.concat(turn, s["b"])), table)
        return F.struct(s["b"].alias("a"), moved.alias("b"))

    return F.aggregate(F.array(*[F.lit(f"{i}{side}") for i in range(ROUNDS) for side in "ab"]), state, step, lambda s: F.concat(s["a"], s["b"]))


def cased(entity: Column, core: Column) -> Column:
    """core with capitals where the entity, of the same length, has them; a letter that would not come back from its capital stays."""
    def capital(c: Column) -> Column:
        return F.when(F.lower(F.upper(c)) == c, F.upper(c)).otherwise(c)

    return F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(c != F.lower(c), capital(F.substring(core, i + 1, F.lit(1)))).otherwise(F.substring(core, i + 1, F.lit(1)))), "")


def luhn_digit(digits: Column) -> Column:
    """The check digit that belongs after these digits."""
    doubled = F.lit("0246813579")
    back = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(F.pmod(i, F.lit(2)) == 0, F.substring(doubled, c.cast("int") + 1, F.lit(1)).cast("int")).otherwise(c.cast("int")))
    return F.pmod(-F.aggregate(back, F.lit(0), lambda s, x: s + x), F.lit(10))


def permuted_octets(ip: Column, key: Column) -> Column:
    parts = F.transform(F.split(ip, r"\."), lambda o: o.cast("int"))

    def step(s: Column, i: Column) -> Column:
        def moved(pair: Column, other: Column, side: str) -> Column:
            hexed = stream(key, "ip", F.concat_ws(",", i.cast("string"), F.lit(side), other[0].cast("string"), other[1].cast("string")))
            return let(hexed, lambda h: F.transform(pair, lambda o, j: F.pmod(o + byte_at(h, j), F.lit(256))))

        return let(moved(s["a"], s["b"], "a"), lambda a: F.struct(a.alias("a"), moved(s["b"], a, "b").alias("b")))

    state = F.struct(F.slice(parts, 1, 2).alias("a"), F.slice(parts, 3, 2).alias("b"))
    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), state, step, lambda s: F.array_join(F.transform(F.concat(s["a"], s["b"]), lambda o: o.cast("string")), "."))


def new_name(core: Column, key: Column, tweak: Column, table: Column) -> Column:
    """A word of a name, by gender and script; each tweak joins one more word of the list, so there are always enough.

    Without lists for its script a word's own letters are permuted, and each tweak joins such a word once more.
    """
    gender, name = F.substring_index(core, "|", 1), F.substring_index(core, "|", -1)
    own = F.transform(F.sequence(F.lit(0), tweak), lambda i: cased(name, permuted(F.lower(name), F.concat_ws("|", key, gender, i.cast("string")), "name", table)))
    listed = let(stream(key, "name", core), lambda hexed: picked(gender, name, hexed, tweak))
    return F.concat(gender, F.lit("|"), F.when(name.rlike(r"[\p{IsLatin}\p{IsCyrillic}]"), listed).otherwise(F.array_join(own, "-")))


def picked(gender: Column, name: Column, hexed: Column, tweak: Column) -> Column:
    def pick(words: list[str], i: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, words)), (F.pmod(byte_at(hexed, i * 2) * 256 + byte_at(hexed, i * 2 + 1), F.lit(len(words))) + 1).cast("int"))

    def script(lists: dict[str, list[str]], i: Column) -> Column:
        return F.when(gender == "f", pick(lists["f"], i)).when(gender == "m", pick(lists["m"], i)).otherwise(pick(lists["last"], i))

    cyrillic = name.rlike(r"\p{IsCyrillic}")
    return F.array_join(F.transform(F.sequence(F.lit(0), tweak), lambda i: F.when(cyrillic, script(NAMES["cyrillic"], i)).otherwise(script(NAMES["latin"], i))), "-")


def surrogate(kind: Column, core: Column, tweak: Column, secret: str) -> Column:
    """The core of the replacement."""
    return let(other_table(), lambda table: surrogate_by(kind, core, tweak, secret, table))


def surrogate_by(kind: Column, core: Column, tweak: Column, secret: str, table: Column) -> Column:
    key = F.concat_ws("|", F.lit(secret), kind, tweak.cast("string"))
    local, domain = F.substring_index(core, "@", 1), F.substring_index(core, "@", -1)
    top = F.substring_index(domain, ".", -1)
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
    # What has nothing to move, and what has met others for several tweaks, needs more characters.
    n_more = F.floor(tweak / GROWS).cast("int") + F.when(F.concat(local, host).rlike(r"[\p{L}\p{N}]"), 0).otherwise(1)
    more = F.substring(stream(key, "more", core), F.lit(1), n_more)
    # The people of one domain keep a common one.
    email = F.concat(permuted(local, F.concat(key, F.lit("|"), domain), "local", table), more, F.lit("@"), permuted(host, key, "host", table), F.lit("."), top)
    code = F.regexp_extract(core, r"^\+(?:1|7|[0-9]{2})", 0)
    phone = F.concat(code, permuted(F.substring(core, F.length(code) + 1, F.length(core)), F.concat(key, code), "phone"))
    # The issuer's digit stays, and so does whether, and by how much, the check digit is off.
    issuer, rest = F.substring(core, 1, 1), F.substring(core, F.lit(2), F.length(core) - 2)
    off = F.pmod(F.substring(core, -1, 1).cast("int") - luhn_digit(F.concat(issuer, rest)), F.lit(10))
    card = let(F.concat(issuer, permuted(rest, F.concat(key, issuer), "card")), lambda b: F.concat(b, F.pmod(luhn_digit(b) + off, F.lit(10)).cast("string")))
    return F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "card", card).when(kind == "ip", permuted_octets(core, key)).when(kind == "ssn", permuted(core, key, "ssn")).otherwise(new_name(core, key, tweak, table))


def formatted(kind: Column, entity: Column, core: Column) -> Column:
    """A core in the shape of the entity that it replaces."""
    email = F.when(F.length(entity) == F.length(core), cased(entity, core)).otherwise(core)
    digits = F.regexp_replace(core, "[^0-9]", "")
    dealt = F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(digits, F.length(F.regexp_replace(F.substring(entity, F.lit(1), i + 1), "[^0-9]", "")), F.lit(1))).otherwise(c)), "")
    title = F.regexp_extract(entity, rf"^{TITLE} ", 0)
    return F.when(kind == "email", email).when(kind == "ip", core).when(kind == "name", F.concat(title, core)).otherwise(dealt)


def entities_of(text: Column) -> Column:
    """Array of (entity, kind, parts), in order, leftmost and non-overlapping."""
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    typed = F.transform(found, lambda e: F.struct(e.alias("entity"), kind_of(e).alias("kind")))
    return F.transform(typed, lambda e: F.struct(e["entity"], e["kind"], parts_of(e["kind"], e["entity"], core_of(e["kind"], e["entity"])).alias("parts")))


def parts_in(text: Column) -> Column:
    """Array of (kind, core) of all entities."""
    return F.flatten(F.transform(entities_of(text), lambda e: e["parts"]))


def tweaks(docs: DataFrame, secret: str, text: str) -> DataFrame:
    """(kind, core, tweak) of the entities that need a tweak: all surrogates are distinct, and none is an entity of the table."""
    with scratch_scope(docs.sparkSession) as keep:
        return keep(materialize(resolved(docs, secret, text), "tweaks"))


def resolved(docs: DataFrame, secret: str, text: str) -> DataFrame:
    every = docs.select(F.explode(parts_in(F.col(text))).alias("e")).select("e.kind", "e.core").distinct()
    every = materialize(every, "entities")
    entities = every.select("kind", F.col("core").alias("new"))
    given = every.withColumn("tweak", F.lit(0))
    new = surrogate(F.col("kind"), F.col("core"), F.col("tweak"), secret)
    while True:
        given = given.withColumn("new", new)
        given = materialize(given, "surrogates")
        # Of several that share a surrogate the one of least tweak, then core, keeps it.
        shared = given.groupBy("kind", "new").agg(F.min(F.struct("tweak", "core")).alias("keeps"), F.count("*").alias("n")).where("n > 1").select("kind", "new", "keeps")
        second = given.join(shared, ["kind", "new"]).where(F.col("core") != F.col("keeps.core")).select("kind", "core")
        taken = given.join(entities, ["kind", "new"], "left_semi").select("kind", "core")
        clash = materialize(second.union(taken).distinct().withColumn("again", F.lit(1)), "clashes")
        if clash.limit(1).count() == 0:
            return given.where("tweak > 0").select("kind", "core", "tweak")
        given = given.drop("new").join(clash, ["kind", "core"], "left").select("kind", "core", (F.col("tweak") + F.coalesce("again", F.lit(0))).alias("tweak"))


def replace_personal_data(docs: DataFrame, secret: str, text: str = "text") -> DataFrame:
    """The same rows and columns with texts rewritten, and `n_found`, how many entities each had. `secret` keys all surrogates.

    A null text stays null with n_found 0; texts without entities stay as they are. Equal texts are rewritten
    alike, so repeated rows stay equal, and one entity reads the same in every text of any table under one
    secret and set of entities. An existing column n_found is replaced; an empty table gives no rows.
    """
    need = tweaks(docs.select(text), secret, text)
    # All columns travel as one, so that none can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("body"))
    n = need.count()
    if n > TWEAKED:
        # By the text's digest, as what a text holds follows from it alone.
        rows = rows.withColumn("sha", F.sha2("body", 256))
        held = rows.select("sha", F.explode(parts_in(F.col("body"))).alias("e")).select("sha", "e.kind", "e.core").distinct()
        of = held.join(need, ["kind", "core"]).groupBy("sha").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "core"), "tweak"))).alias("known"))
        rows = rows.join(materialize(of, "tweaks"), "sha", "left")
        known = F.col("known")
    else:
        # At most TWEAKED entities, in the plan itself, so that no text is shuffled for them.
        table = {f"{r.kind}|{r.core}": r.tweak for r in need.collect()}
        known = F.from_json(F.lit(json.dumps(table)), "map<string,int>") if table else None

    def part(p: Column) -> Column:
        tweak = F.lit(0) if known is None else F.coalesce(F.try_element_at(known, F.concat_ws("|", p["kind"], p["core"])), F.lit(0))
        return surrogate(p["kind"], p["core"], tweak, secret)

    def new(e: Column) -> Column:
        whole = lambda own: F.when(e["kind"] == "name", F.array_join(F.transform(own, lambda x: F.substring_index(x, "|", -1)), " ")).otherwise(own[0])
        return let(let(F.transform(e["parts"], part), whole), lambda core: formatted(e["kind"], e["entity"], core))

    rows = rows.withColumn("found", entities_of(F.col("body")))
    gaps = F.split("body", F.lit(ANY), -1)
    joined = F.array_join(F.zip_with(gaps, F.transform("found", new), lambda gap, own: F.concat(gap, F.coalesce(own, F.lit("")))), "")
    count = F.greatest(F.coalesce(F.size("found"), F.lit(0)), F.lit(0)).cast("long")
    rows = rows.select("row", count.alias("n"), F.when(count > 0, joined).otherwise(F.col("body")).alias("body"))
    return rows.select(*[F.col("n" if c == "n_found" else "body").alias(c) if c in ("n_found", text) else F.col("row")[c].alias(c) for c in dict.fromkeys([*docs.columns, "n_found"])])
