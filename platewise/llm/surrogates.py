"""Private data replaced by surrogates of the same type and format, from DataFrame operations only.

Mentions are found by regular expressions and reduced to entities (kind, norm): the digits of a number, the lower-case
form of an address, every token of a name. An entity's surrogate is drawn from a keyed hash, so equal entities get
equal surrogates in all documents; it is checked against all other surrogates and all real entities of its kind and
drawn again while it collides; where a format is so full that draws don't end, the values that are still free are
given out in order. A mention takes the surrogate in its own format: separators stay, capitals stay capitals. Names
keep their title and stay in their script; a card number that satisfies the Luhn check is replaced by one that does;
surrogate addresses lie in a reserved domain.

A token of a name is one entity wherever it stands, as a given name or a surname. It takes the gender that the titles
show of the people it is a given name of, and none if they differ or show none. The tokens of a titled name are
replaced in the rest of its document too, where they stand without a title (n_entities doesn't count those).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platewise.llm.common import landed, salted_join

KEY = "set a secret of your own"
MOST_DRAWS = 40

FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Г-жа", "Госпожа")
MALE = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Г-н", "Господин")
NEUTRAL = ("Dr", "Prof")
_TITLE = "|".join(sorted((*FEMALE, *MALE, *NEUTRAL), key=lambda t: (-len(t), t)))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_FREE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_WORD = r"\p{Lu}(?:[\p{L}\p{M}]|['’](?!s(?!\p{L}))(?=\p{L})|-(?=\p{L}))+"
_TOKEN = rf"(?:\p{{Lu}}\.(?= \p{{Lu}})|(?:(?:de|la|del|van|von|der|den|di|da|du|le|al|bin|ibn|el|dos) )*{_WORD})"
#: Where a capitalised word starts.
_WORDS = r"(?<![\p{L}\p{N}]|[\p{L}\p{M}]['’-])(?=\p{Lu})"
_HEX = "[0-9A-Fa-f]{1,4}"
#: Tried in this order at every place of a text.
PATTERNS = {
    "email": r"[\p{L}\p{N}][\p{L}\p{N}._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": _FREE + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?" + _END,
    "key": _FREE + r"(?:AKIA[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{35}|(?:sk|pk|gh[pousr])[-_][A-Za-z0-9_-]{16,}|xox[abpr]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)" + _END,
    "ipv6": rf"(?<![\p{{L}}\p{{N}}:])(?:(?:{_HEX}:){{7}}{_HEX}|(?=[A-Fa-f:]*[0-9])[0-9A-Fa-f]{{3,4}}(?::{_HEX}){{0,5}}::(?:{_HEX}(?::{_HEX}){{0,5}})?)(?![\p{{L}}\p{{N}}:])",
    "secret": _FREE + r"(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})" + _END,
    "ip": r"(?<![\p{L}\p{N}.])" + _OCTET + rf"(?:\.{_OCTET}){{3}}" + r"(?![\p{L}\p{N}]|\.\d)",
    "card": _FREE + r"(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5})" + _END,
    "ssn": _FREE + r"\d{3}-\d{2}-\d{4}" + _END,
    "phone": r"(?<![\p{L}\p{N}+])(?:(?:\+\d{1,3}[ .-]?(?:\(0\))?|0)\d(?:[ .-]?\d{2}){4}|\d{3}\.\d{3}\.\d{4}|\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})" + _END,
    "name": _FREE + rf"(?:{_TITLE})\.?(?: {_TOKEN})+",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Every mention holds a match of this, which is quickly tested.
HINT = rf"[0-9@]|(?:{_TITLE})\.? [\p{{Lu}}dlvbe]|AKIA|AIza|(?:sk|pk|gh[pousr])[-_]|xox[abpr]-|eyJ"
#: 32 hex letters without a digit would escape the hint; they are looked for on their own.
HINT += r"|[a-f]{32}|[A-F]{32}"

# Script, syllables of names in it, and endings of female, male and other names.
_LATIN = ("ba", "de", "ki", "lo", "mu", "na", "re", "si", "to", "vu", "ga", "le", "mi", "no", "ru", "ta")
_CYRILLIC = ("ба", "де", "ки", "ло", "му", "на", "ре", "си", "то", "ву", "га", "ле", "ми", "но", "ру", "та")
_GREEK = ("βα", "δε", "κι", "λο", "μυ", "να", "ρε", "σι", "το", "βυ", "γα", "λε", "μι", "νο", "ρυ", "τα")
_ARMENIAN = ("բա", "դե", "կի", "լո", "մու", "նա", "ռե", "սի", "տո", "վու", "գա", "լե", "մի", "նո", "ռու", "տա")
SCRIPTS = {"Cyrillic": (_CYRILLIC, ("на", "н", "р")), "Greek": (_GREEK, ("να", "ν", "ρ")), "Armenian": (_ARMENIAN, ("նա", "ն", "ր")), "Latin": (_LATIN, ("na", "n", "r"))}


def mentions(text: Column) -> Column:
    """The mentions of a text in order; none for null."""
    none = F.array().cast("array<string>")
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none)


def kind_of(mention: Column) -> Column:
    return reduce(lambda rest, kp: F.when(mention.rlike(f"^(?:{kp[1]})$"), kp[0]).otherwise(rest), reversed(list(PATTERNS.items())), F.lit("name"))


def name_tokens(mention: Column) -> Column:
    """All tokens after the title."""
    return F.slice(F.split(mention, " "), F.lit(2), F.size(F.split(mention, " ")))


def parts_of(mention: Column, kind: Column) -> Column:
    """The entities (kind, norm, gender) of a mention: one, or one for each token of a name. gender is f, m or null.
    A single token after a title is a surname, of which the title tells no gender."""
    digits = F.regexp_replace(mention, "[^0-9]", "")
    norm = F.when(kind.isin("card", "ssn", "phone"), digits).when(kind == "iban", F.replace(mention, F.lit(" "), F.lit(""))).when(kind == "key", mention).otherwise(F.lower(mention))
    title = F.regexp_extract(mention, rf"^({_TITLE})", 1)
    gender = F.when(title.isin(*FEMALE), "f").when(title.isin(*MALE), "m")
    tokens = name_tokens(mention)
    named = F.transform(tokens, lambda t, i: F.struct(kind.alias("kind"), F.lower(t).alias("norm"), F.when(i + 1 < F.size(tokens), gender).alias("gender")))
    return F.when(kind == "name", named).otherwise(F.array(F.struct(kind.alias("kind"), norm.alias("norm"), F.lit(None).cast("string").alias("gender"))))


def _each(x: Column, f) -> Column:
    return F.array_join(F.transform(F.split(x, ""), f), "")


def _luhn(x: Column) -> Column:
    d = F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: c.cast("int"))
    twice = F.transform(d, lambda v, i: F.when((F.size(d) - i) % 2 == 0, F.when(v > 4, 2 * v - 9).otherwise(2 * v)).otherwise(v))
    return F.aggregate(twice, F.lit(0), lambda a, b: a + b) % 10


def _mod97(x: Column) -> Column:
    """The number that capital letters (10 to 35) and digits spell, modulo 97."""
    letter = lambda c: c.rlike("^[A-Z]$")
    step = lambda a, c: (a * F.when(letter(c), 100).otherwise(10) + F.ascii(c) - F.when(letter(c), 55).otherwise(48)) % 97
    return F.aggregate(F.filter(F.split(x, ""), lambda c: c.rlike("^[A-Z0-9]$")), F.lit(0), step)


def drawn(entities: DataFrame, key: str, attempt: int) -> DataFrame:
    """kind, norm and core: a surrogate of each entity. An entity is hashed once, whatever its length."""
    h = F.sha2(F.concat_ws("|", F.lit(key), "kind", "norm", F.lit(str(attempt))), 256)
    hashed = entities.withColumn("_h", h).withColumns({"_digits": F.translate("_h", "abcdef", "012345"), "_letters": F.translate("_h", "0123456789", "ghijklmnop")})
    return hashed.select("kind", "norm", draw(*map(F.col, ("kind", "norm", "gender", "_h", "_digits", "_letters")), attempt).alias("core"))


def draw(kind: Column, norm: Column, gender: Column, h: Column, digits: Column, letters: Column, attempt: int) -> Column:
    """The surrogate of an entity, in normal form, from its hash. Names and addresses grow with the attempts. Cards and
    account numbers whose check digits hold get some that hold."""
    n = F.length(norm)

    def at(s: Column, i: Column) -> Column:
        return F.substring(s, i % 64 + 1, F.lit(1))

    def alike(x: Column) -> Column:
        return _each(x, lambda c, i: F.when(c.rlike("^[0-9]$"), at(digits, i)).when(c.rlike(r"^\p{Lu}$"), F.upper(at(letters, i))).when(c.rlike(r"^\p{L}$"), at(letters, i)).otherwise(c))

    number = F.substring(digits, F.lit(1), n)
    body = F.substring(digits, F.lit(1), n - 1)
    card = F.when(_luhn(norm) == 0, F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0")))) % 10).cast("string"))).otherwise(number)
    phone = F.concat(F.substring(norm, 1, 1), F.substring(digits, F.lit(2), n - 1))
    byte = [F.conv(F.substring(h, 2 * i + 1, 2), 16, 10).cast("int") for i in range(4)]
    ip = F.concat_ws(".", (1 + byte[0] % 223).cast("string"), *(b.cast("string") for b in byte[1:]))
    email = F.concat(alike(F.substring_index(norm, "@", 1)), F.lit("@m"), F.substring(letters, 41, 6 + min(attempt, 18)), F.lit(".example.net"))
    country, account = F.substring(norm, 1, 2), alike(F.substring(norm, F.lit(5), n - 4))
    check = F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, F.lit("0"))
    sound = _mod97(F.concat(F.substring(norm, F.lit(5), n), F.substring(norm, 1, 4))) == 1
    iban = F.concat(country, F.when(sound, check).otherwise(alike(F.substring(norm, 3, 2))), account)
    name = None
    for script, (syllables, endings) in reversed(SCRIPTS.items()):
        known = F.array(*map(F.lit, syllables))
        body_ = [F.element_at(known, F.conv(F.substring(h, i, 1), 16, 10).cast("int") + 1) for i in range(1, 6 + min(attempt, 30))]
        x = F.concat(*body_, F.when(gender == "f", endings[0]).when(gender == "m", endings[1]).otherwise(endings[2]))
        name = x if name is None else F.when(norm.rlike(rf"\p{{Is{script}}}"), x).otherwise(name)
    return (
        F.when(kind == "key", alike(norm)).when(kind == "ipv6", F.concat(F.lit("2001:db8"), *(x for i in range(6) for x in (F.lit(":"), F.substring(h, 4 * i + 1, 4))))).when(kind == "card", card).when(kind == "ssn", number).when(kind == "phone", phone).when(kind == "ip", ip).when(kind == "secret", F.substring(h, F.lit(1), n)).when(kind == "email", email).when(kind == "iban", iban).otherwise(name)
    )


def surrogates(entities: DataFrame, key: str = KEY, most_draws: int = MOST_DRAWS) -> DataFrame:
    """kind, norm and core of distinct entities (kind, norm, gender): no core equals another one or a real entity of its
    kind."""
    entities = landed(entities.distinct(), "entities")
    real = entities.select("kind", F.col("norm").alias("core"))
    done, open_ = None, entities
    for attempt in range(most_draws):
        new = drawn(open_, key, attempt)
        best = new.groupBy("kind", "core").agg(F.min("norm").alias("norm"))  # one of several keeps it
        best = best.join(real, ["kind", "core"], "left_anti")
        if done is not None:
            best = best.join(done.select("kind", "core"), ["kind", "core"], "left_anti")
        best = best.select("kind", "norm", "core")
        done = landed(best if done is None else done.unionByName(best), "surrogates")
        open_ = landed(entities.join(done, ["kind", "norm"], "left_anti"), "open")
        if open_.isEmpty():
            return done
    return done.unionByName(free_values(open_, done, real))


def free_values(open_: DataFrame, done: DataFrame, real: DataFrame) -> DataFrame:
    """kind, norm and core of the open entities: the first values of their format that are neither taken nor real.

    Formats are numbers of one length (of one first digit for telephones) and addresses of four bytes; a number whose
    format has no free value left gets more digits.
    """
    odd = open_.filter(~F.col("kind").isin("card", "ssn", "phone", "ip")).first()
    if odd is not None:
        raise RuntimeError(f"no surrogate found for a {odd['kind']}")
    wide, lead = F.when(F.col("kind") == "ip", 0).otherwise(F.length("norm")).alias("wide"), F.when(F.col("kind") == "phone", F.substring("norm", 1, 1)).otherwise("").alias("lead")
    open_ = landed(open_.select("kind", "norm", wide, lead), "open")
    formats = landed(open_.groupBy("kind", "wide", "lead").agg(F.count("*").alias("wanted")), "formats")
    most = formats.agg(F.max("wanted")).first()[0]
    i = F.col("i")
    number = F.concat("lead", F.lpad(i.cast("string"), F.greatest(F.col("wide") - F.length("lead"), F.length(i.cast("string"))), F.lit("0")))
    address = F.concat_ws(".", *(F.shiftright(i + (1 << 24), k).bitwiseAND(F.lit(255)).cast("string") for k in (24, 16, 8, 0)))
    size = 4 * most
    while True:
        values = open_.sparkSession.range(size).withColumnRenamed("id", "i").crossJoin(F.broadcast(formats)).withColumn("core", F.when(F.col("kind") == "ip", address).otherwise(number))
        values = values.join(done, ["kind", "core"], "left_anti").join(real, ["kind", "core"], "left_anti")
        free = landed(values.select("kind", "wide", "lead", "core", "i", "wanted"), "free")
        if free.groupBy("kind", "wide", "lead").agg(F.count("*").alias("n"), F.first("wanted").alias("w")).filter("n < w").isEmpty():
            break
        size *= 4
    by = W.partitionBy("kind", "wide", "lead")
    free = free.withColumn("place", F.row_number().over(by.orderBy("i"))).filter("place <= wanted")
    open_ = open_.withColumn("place", F.row_number().over(by.orderBy("norm")))
    return open_.join(free, ["kind", "wide", "lead", "place"]).select("kind", "norm", "core")


def render(mention: Column, kind: Column, cores: Column) -> Column:
    """A mention with its surrogate, in its own format."""
    core = F.element_at(cores, 1)

    def place(i: Column) -> Column:
        return F.length(F.regexp_replace(F.substring(mention, F.lit(1), i), "[^0-9A-Z]", "")) + 1

    filled = _each(mention, lambda c, i: F.when(c.rlike("^[0-9A-Z]$"), F.substring(core, place(i), F.lit(1))).otherwise(c))
    capitals = (mention == F.upper(mention)) & (mention != F.lower(mention))
    title, given = F.substring_index(mention, " ", 1), name_tokens(mention)
    name = F.concat_ws(" ", title, F.array_join(F.zip_with(given, cores, lambda g, c: F.when(g == F.upper(g), F.upper(c)).otherwise(F.initcap(c))), " "))
    return F.when(kind.isin("card", "ssn", "phone", "iban"), filled).when(kind.isin("ip", "key"), core).when(kind == "name", name).when(capitals, F.upper(core)).otherwise(core)


def replace_private(docs: DataFrame, *, text: str = "text", key_column: str = "doc_id", key: str = KEY) -> DataFrame:
    """The rows with their mentions replaced, and n_entities (mentions) and kinds (sorted) added.

    Null and empty texts and texts without mentions stay as they are. Repeated rows get equal results. Columns of the
    names n_entities and kinds are replaced; others stay, whatever their names. Equal entities get equal surrogates wherever they occur,
    different ones different surrogates. A very long text is one value of an expression; its cost grows with its length,
    and with the number of its words times that of its different names.
    """
    names = [c for c in docs.columns if c not in ("n_entities", "kinds")]
    columns = [f"_{i}" for i in range(len(names))]
    docs = docs.select(*(F.col(f"`{c}`") for c in names)).toDF(*columns)
    text, key_column = columns[names.index(text)], columns[names.index(key_column)]
    at = ["_id", "_mark"]
    # Texts pass the patterns once; what follows reads the mentions.
    base = docs.select(*columns, F.coalesce(F.col(key_column).cast("string"), F.lit("")).alias("_id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("_mark"), mentions(F.col(text)).alias("_m"))
    base = landed(base, "read")
    found = base.filter(F.size("_m") > 0).select(*at, F.col("_m").alias("m")).distinct()
    each = found.select(*at, F.posexplode("m").alias("pos", "mention")).withColumn("kind", kind_of(F.col("mention")))
    each = landed(each.withColumn("parts", parts_of(F.col("mention"), F.col("kind"))), "mentions")
    part = each.select(*at, "pos", F.posexplode("parts").alias("k", "p")).select(*at, "pos", "k", "p.*")
    known = part.groupBy("kind", "norm").agg(F.min("gender").alias("least"), F.max("gender").alias("most"))
    cores = surrogates(known.select("kind", "norm", F.when(F.col("least") == F.col("most"), F.col("least")).alias("gender")), key)
    wanted = salted_join(part.select(*at, "pos", "k", "kind", "norm"), cores, ["kind", "norm"], "_id")
    wanted = wanted.groupBy(*at, "pos").agg(F.array_sort(F.collect_list(F.struct("k", "core"))).alias("cores"))
    new = each.join(wanted, [*at, "pos"]).withColumn("new", render(F.col("mention"), F.col("kind"), F.transform("cores", lambda c: c["core"])))
    # Tokens of the names and what replaces them where they stand alone.
    tokens = F.zip_with(name_tokens(F.col("mention")), name_tokens(F.col("new")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    tokens = F.when(F.col("kind") == "name", F.filter(tokens, lambda p: p["a"].rlike(rf"^{_WORD}$")))
    plan = new.groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("pos", "new"))).alias("new"), F.array_sort(F.collect_set("kind")).alias("kinds"), F.array_distinct(F.flatten(F.collect_list(tokens))).alias("alone"))
    plan = landed(plan.select(*at, F.transform("new", lambda x: x["new"]).alias("new"), "kinds", "alone"), "plan")
    marked = base.filter(F.size("_m") > 0).drop("_m").join(plan.hint("merge"), at)
    pieces = F.array_join(F.zip_with(F.split(F.col(text), ANY, -1), F.concat("new", F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")

    def renamed(piece: Column) -> Column:
        """A piece that starts with a capitalised word, which is replaced if it is one of the tokens."""
        head = F.regexp_extract(piece, rf"^({_WORD}){_END}", 1)
        place = F.array_position(F.col("alone.a"), head).cast("int")
        return F.when((head != "") & (place > 0), F.concat(F.element_at("alone.b", place), F.substring(piece, F.length(head) + 1, F.length(piece)))).otherwise(piece)

    changed = F.when(F.size("alone") > 0, F.array_join(F.transform(F.split(pieces, _WORDS, -1), renamed), "")).otherwise(pieces)
    marked = marked.select(*(changed.alias(text) if c == text else F.col(c) for c in columns), F.size("new").cast("long").alias("n_entities"), "kinds")
    none = F.array().cast("array<string>")
    plain = base.filter(F.size("_m") == 0).select(*columns, F.lit(0).cast("long").alias("n_entities"), none.alias("kinds"))
    return marked.unionByName(plain).toDF(*names, "n_entities", "kinds")
