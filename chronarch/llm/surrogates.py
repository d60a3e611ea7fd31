"""Personal data replaced by keyed surrogates, with DataFrame functions alone.

Entities are found by patterns.  Every different entity of the corpus gets one
surrogate, made from a keyed digest, so it stays the same wherever the entity
stands.  The table of surrogates is checked for two entities with one surrogate
and for surrogates that are entities themselves; those are drawn again.

Entities alone are grouped by what they are.  The text of a document with entities
goes through one shuffle, to where its surrogates are; the others through none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronarch.llm.tables import cut, prepare, with_results, written

#: Titles before names, by gender (fixed values).
FEMALE = ("Mrs", "Ms", "Miss", "Madame", "Mme", "Frau", "Señora", "Sra", "Госпожа")
MALE = ("Mr", "Monsieur", "Herr", "Señor", "Sr", "Господин")
EITHER = ("Dr", "Prof", "Professor")
_TITLES = "|".join(sorted((*FEMALE, *MALE, *EITHER), key=len, reverse=True))

#: Letters of names by script, consonants and vowels in turn; where a script has no such order, the same letters twice (fixed values).
SCRIPTS = {
    "Latin": ("bdfgklmnprstvz", "aeiou"),
    "Cyrillic": ("бвгдзклмнпрст", "аеиоу"),
    "Greek": ("βγδζκλμνπρστφχ", "αεηιουω"),
    "Armenian": ("բգդզթլխկհմնպռսվտրքֆ", "աեիու"),
    "Hebrew": ("אבגדהוזחטיכלמנסעפצקרשת", "אבגדהוזחטיכלמנסעפצקרשת"),
    "Arabic": ("بتجحدرزسشصطعفقكلمنهوي", "بتجحدرزسشصطعفقكلمنهوي"),
    "Han": ("王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗", "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀霞平"),
    "Hangul": ("김이박최정강조윤장임한오서신권황안송류홍", "민서준지현수영진은혜성우태경호유나린빈아"),
    "Hiragana": ("かきくけこさしすせそたちつてとなにのはひふへほまみむめも", "あいうえおやゆよらりるれろわ"),
    "Katakana": ("カキクケコサシスセソタチツテトナニノハヒフヘホマミムメモ", "アイウエオヤユヨラリルレロワ"),
}
#: Scripts with capitals, and with what a woman's given name ends there (fixed values).
ENDINGS = {"Latin": "a", "Cyrillic": "а", "Greek": "α"}
_LETTER = "".join(rf"\p{{Is{s}}}" for s in SCRIPTS)
_UNCASED = "".join(rf"\p{{Is{s}}}" for s in SCRIPTS if s not in (*ENDINGS, "Armenian"))
_NAME = rf"(?:(?=\p{{Lu}})[{_LETTER}](?:[{_LETTER}]|(?:(?!\p{{L}})['-]))++|(?=\p{{L}})[{_UNCASED}]++)"
#: Words within a name that stay as they are (fixed values).
PARTICLES = ("van", "von", "der", "den", "de", "del", "della", "di", "da", "dos", "du", "la", "le", "bin", "ibn", "al", "el", "ter", "ten", "zu", "zur", "vom")
_PARTICLE = rf"(?:{'|'.join(PARTICLES)})(?!\p{{L}})"
_INITIALS = r"(?:[A-Z]\.)++"
_BLANK = r"[ \t\u00A0]++"
#: Any number of parts with particles and initials before them; only after the title may a line end.
_WHOLE_NAME = rf"(?:(?:{_PARTICLE}|{_INITIALS})[ \t\u00A0]*+)*{_NAME}(?:{_BLANK}(?:(?:{_PARTICLE}|{_INITIALS})[ \t\u00A0]*+)*{_NAME})*"
_AFTER_TITLE = r"\.?(?:[ \t\u00A0]++(?:\r?\n[ \t\u00A0]*+)?|\r?\n[ \t\u00A0]*+)"
#: How secret tokens of some services begin; that stays (fixed values).
TOKEN_PREFIX = r"(?:sk|pk|ghp|gho|xoxb|xoxp|AKIA)[_-]?"

#: Patterns by kind, in the order in which they are tried (fixed values).
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "token": rf"(?<![0-9A-Za-z])(?:(?:[0-9a-f]{{32,}}+|[0-9A-F]{{32,}}+)(?![0-9A-Za-z])|{TOKEN_PREFIX}[A-Za-z0-9_-]{{16,}}+)",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)",
    "card": r"(?<![\d.])(?:\d{4}[ -]?){3}\d{4}(?!\d)|(?<![\d.])3\d{3}[ -]?\d{6}[ -]?\d{5}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "ipv6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]{0,40}\d)(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "name": rf"(?<!\p{{L}})(?:{_TITLES}){_AFTER_TITLE}{_WHOLE_NAME}",
}
ALL = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: The country of a phone number, which stays.
COUNTRY = r"^\+\d{1,3}(?=[ (.-])"
#: The same, at the head of a number's canonical form.
LAND = r"^\+\d{1,3}:"
#: What every entity but names has, and what names have: cheap tests before the patterns.
MAYBE, MAYBE_NAME = "[0-9@]|(?:sk|pk|ghp|gho|xoxb|xoxp|AKIA)[A-Za-z_-]{16}|[a-f]{32}|[A-F]{32}", rf"(?:{_TITLES})\.?\s+\p{{L}}"
#: What may follow a name and is no part of it.
OWNER = "'s?$"
#: Names get longer with each round of drawing again after half of ROUNDS; after MOST_ROUNDS it is an error that surrogates are not distinct.
ROUNDS, MOST_ROUNDS = 12, 64


def _kind(entity: Column) -> Column:
    kinds = [(F.lit(k), entity.rlike(rf"^(?:{p})$")) for k, p in PATTERNS.items()]
    return F.coalesce(*[F.when(fits, k) for k, fits in kinds])


def _parts(entity: Column, kind: Column, names: Column) -> Column:
    """What of the entity is replaced: (kind, canonical form), the same for all spellings of one entity."""
    title = F.regexp_extract(entity, r"^([^.\s]+)", 1)
    given = F.when(title.isin(*FEMALE), "given_f").when(title.isin(*MALE), "given_m").otherwise("given")
    part = lambda k, c: F.struct(k.alias("kind"), c.alias("canon"))
    last = F.array(part(F.lit("surname"), F.lower(F.element_at(names, -1))))
    first = F.transform(F.slice(names, F.lit(1), F.size(names) - 1), lambda n: part(given, F.lower(n)))
    country = F.regexp_extract(entity, COUNTRY, 0)
    bare = F.regexp_replace(F.regexp_replace(entity, COUNTRY, ""), r"[^\p{L}\p{N}]", "")
    plain = F.when(kind.isin("email", "ipv6"), F.lower(entity)).when(kind.isin("ip", "token"), entity).when((kind == "phone") & (country != ""), F.concat(country, F.lit(":"), bare)).otherwise(bare)
    return F.when(kind == "name", F.concat(first, last)).otherwise(F.array(part(kind, plain)))


def _words(name: Column) -> Column:
    """The words and initials of a name after its title, and the blanks between them, without a genitive's end."""
    rest = F.regexp_replace(F.regexp_replace(name, rf"^(?:{_TITLES}){_AFTER_TITLE}", ""), OWNER, "")
    return F.regexp_extract_all(rest, F.lit(rf"\s+|{_INITIALS}|[^\s]+"), F.lit(0))


def _stays(word: Column) -> Column:
    """Whether a word of a name is a particle or initials."""
    return word.isin(*PARTICLES) | word.rlike(rf"^{_INITIALS}$")


def _pick(digest: Column, i: Column, letters: Column) -> Column:
    """The letter for place i that the digest's byte there chooses; null where letters is."""
    byte = F.conv(F.substring(digest, (i % 128) * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return F.substring(letters, byte % F.length(letters) + 1, F.lit(1))


def _check_digits(kind: Column, text: Column) -> Column:
    """``text`` with the check digits that card numbers (Luhn) and accounts (modulo 97) need."""
    values = F.transform(F.split(F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, 1, 2), F.lit("00")), ""), lambda c: F.conv(c, 36, 10).cast("int"))
    rest = F.aggregate(values, F.lit(0), lambda r, v: (r * F.when(v > 9, 100).otherwise(10) + v) % 97)
    account = F.concat(F.substring(text, 1, 2), F.lpad((98 - rest).cast("string"), 2, "0"), F.substring(text, F.lit(5), F.length(text)))
    digits = F.transform(F.reverse(F.split(F.substring(text, F.lit(1), F.length(text) - 1), "")), lambda c, i: c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    total = F.aggregate(digits, F.lit(0), lambda s, d: s + d - F.when(d > 9, 9).otherwise(0))
    card = F.concat(F.substring(text, F.lit(1), F.length(text) - 1), ((10 - total % 10) % 10).cast("string"))
    return F.when(kind == "iban", account).when(kind == "card", card).otherwise(text)


def _surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    seed = F.concat_ws("\x1f", F.lit(key), kind, attempt.cast("string"), canon)
    digest = F.concat(F.sha2(seed, 512), F.sha2(F.concat(seed, F.lit("\x1f")), 512))
    longer = F.greatest(F.lit(0), attempt - ROUNDS // 2)
    stays = F.when(kind == "token", F.regexp_extract(canon, f"^{TOKEN_PREFIX}", 0)).when(kind == "iban", F.substring(canon, 1, 2)).when(kind == "phone", F.regexp_extract(canon, LAND, 0)).otherwise("")
    hexadecimal = (kind == "ipv6") | (kind == "token") & canon.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
    head = F.substring(canon, 1, 2)
    script = F.coalesce(*[F.when(head.rlike(rf"^.?\p{{Is{x}}}"), x) for x in SCRIPTS], F.lit("Latin"))
    # Names sound: an even number of letters ends in a vowel, an odd one in a consonant.
    name_length = F.greatest(F.when(script.isin(*ENDINGS, "Armenian"), 5).otherwise(1), F.length(canon)) + 2 * longer
    odd, even = name_length - (name_length % 2) + 1, name_length + (name_length % 2)
    ending = F.coalesce(*[F.when(script == x, letter) for x, letter in ENDINGS.items()], F.lit(""))
    more = F.when(longer > 0, attempt.cast("string")).otherwise("")
    spelled = F.coalesce(*[F.when(script == x, F.array(F.lit(some), F.lit(others))) for x, (some, others) in SCRIPTS.items()])

    def draw(told: Column) -> Column:
        """The surrogate; what holds for the whole entity is in ``told``, worked out once and not for each letter."""

        def same_class(c: Column, i: Column) -> Column:
            letters = F.when(told["hexadecimal"] & c.rlike("[0-9a-f]"), "0123456789abcdef").when(told["hexadecimal"] & c.rlike("[A-F]"), "0123456789ABCDEF")
            letters = letters.when(c.rlike("[0-9]"), "0123456789").when(c.rlike("[a-z]"), "abcdefghijklmnopqrstuvwxyz").when(c.rlike("[A-Z]"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
            for x, (some, others) in SCRIPTS.items():
                letters = letters.when(c.rlike(rf"\p{{Is{x}}}"), "àáâäçèéêëíîïñóôöùúûü" if x == "Latin" else "".join(dict.fromkeys(some + others)))
            return F.coalesce(_pick(told["digest"], i, letters), c)

        sound = lambda i: _pick(told["digest"], i, told["spelled"][i % 2])
        alike = lambda text: F.array_join(F.transform(F.split(text, ""), same_class), "")
        spoken = lambda n: F.array_join(F.transform(F.sequence(F.lit(0), n - 1), sound), "")
        host = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: _pick(told["domain"], i, F.lit("abcdefghijklmnopqrstuvwxyz"))), "")  # one for all of a domain
        octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.conv(F.substring(told["digest"], i * 2 + 1, F.lit(2)), 16, 10).cast("int") % 254 + 1).cast("string")), ".")
        mailbox = F.regexp_extract(canon, "^(.*)@", 1)
        changed = alike(F.when(kind == "email", mailbox).otherwise(F.substring(canon, F.length(stays) + 1, F.length(canon))))
        whole = F.concat(stays, changed)
        return (
            F.when(kind == "email", F.concat(changed, more, F.lit("@"), host, F.lit(".example")))
            .when(kind == "ip", octets)
            .when(kind == "surname", spoken(even))
            .when(kind.isin("given_m", "given"), spoken(odd))
            .when(kind == "given_f", F.concat(spoken(odd), ending))
            .when(kind == "token", F.concat(whole, more))
            .otherwise(whole)
        )

    domain = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("domain"), F.regexp_extract(canon, "@(.*)$", 1)), 512)
    told = F.struct(digest.alias("digest"), domain.alias("domain"), hexadecimal.alias("hexadecimal"), spelled.alias("spelled"))
    return F.transform(F.transform(F.array(told), draw), lambda text: _check_digits(kind, text))[0]


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate) of distinct (kind, canon): no two of a kind alike, and none that is an entity of the corpus.

    Given and family names are one kind here.  Kinds of a fixed form (a card number
    has 10**15, an address 254**4) come out distinct after a few rounds.  Names,
    e-mail addresses and tokens get longer after half of ``ROUNDS``.  Surrogates that
    are not distinct after ``MOST_ROUNDS``, the last draw included, are an error.
    """
    space = F.when(F.col("kind").startswith("given") | (F.col("kind") == "surname"), "name").otherwise(F.col("kind")).alias("space")
    drawn = entities.withColumn("attempt", F.lit(0))
    for _ in range(MOST_ROUNDS):
        drawn = cut(drawn.select("kind", space, "canon", "attempt", _surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key).alias("surrogate")))
        # Of those with one surrogate, the one drawn first keeps it.
        keeper = drawn.groupBy("space", "surrogate").agg(F.min(F.struct("attempt", "canon", "kind")).alias("keeper"), F.count("*").alias("n"))
        real = entities.select(space, F.col("canon").alias("surrogate"), F.lit(True).alias("real")).distinct()
        bad = keeper.join(real, ["space", "surrogate"], "left").where("n > 1 OR real")
        bad = cut(bad)
        if bad.isEmpty():
            return drawn.select("kind", "canon", "surrogate")
        drawn = drawn.join(bad, ["space", "surrogate"], "left")
        again = F.col("real") | (F.col("n") > 1) & (F.col("keeper") != F.struct("attempt", "canon", "kind"))
        drawn = drawn.select("kind", "canon", (F.col("attempt") + F.coalesce(again, F.lit(False)).cast("int")).alias("attempt"))
    raise RuntimeError(f"surrogates are not distinct after {MOST_ROUNDS} rounds: {[tuple(r) for r in bad.groupBy('space').count().collect()]}")


def _one_gender(parts: DataFrame) -> DataFrame:
    """``parts`` with one kind for each given name: the gender of its titles, none if they differ or tell none."""
    f, m = (F.max(F.col("kind") == k) for k in ("given_f", "given_m"))
    given = parts.where(F.col("kind").startswith("given")).groupBy("canon").agg(F.when(f & ~m, "given_f").when(m & ~f, "given_m").otherwise("given").alias("one"))
    joined = parts.join(given, "canon", "left")
    return joined.withColumn("kind", F.when(F.col("kind").startswith("given"), F.col("one")).otherwise(F.col("kind"))).drop("one")


def _mentions(gap: Column, names: Column) -> Column:
    """The words of a gap and what is between them, (text, put): names of the document without a title are replaced."""

    def word(w: Column) -> Column:
        bare = F.regexp_replace(w, OWNER, "")
        new = F.when(w.rlike(rf"^(?:\p{{Lu}}|[{_UNCASED}])"), F.coalesce(names[F.lower(bare)], names[F.lower(w)]))
        owner = F.when(names[F.lower(bare)].isNotNull(), F.regexp_extract(w, OWNER, 0)).otherwise("")
        shouted = (F.length(bare) > 1) & (F.upper(bare) == bare)
        new = F.concat(F.when(shouted, F.upper(new)).otherwise(F.initcap(new)), owner)
        return F.struct(F.coalesce(new, w).alias("text"), new.isNotNull().alias("put"))

    whole = F.array(F.struct(gap.alias("text"), F.lit(False).alias("put")))
    return F.when(names.isNull(), whole).otherwise(F.transform(F.regexp_extract_all(gap, F.lit(r"\p{L}[\p{L}'-]*+|[^\p{L}]++"), F.lit(0)), word))


def _rendered(entity: Column, kind: Column, parts: Column) -> Column:
    """The entity with its parts replaced, in its own format and letter case."""
    first = F.regexp_replace(parts[0], LAND, "")
    start = F.struct(F.lit("").alias("text"), F.lit(1).alias("at"))

    def fill(done: Column, c: Column) -> Column:
        other = F.substring(first, done["at"], F.lit(1))
        put = F.when(c.rlike(r"\p{Lu}"), F.upper(other)).otherwise(other)
        return F.when(c.rlike(r"[\p{L}\p{N}]"), F.struct(F.concat(done["text"], put).alias("text"), (done["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(done["text"], c).alias("text"), done["at"].alias("at")))

    country = F.when(kind == "phone", F.regexp_extract(entity, COUNTRY, 0)).otherwise("")
    rest = F.substring(entity, F.length(country) + 1, F.length(entity))
    formatted = F.concat(country, F.aggregate(F.split(rest, ""), start, fill, lambda d: d["text"]))
    title = F.regexp_extract(entity, rf"^(?:{_TITLES}){_AFTER_TITLE}", 0)
    begin = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))

    def spell(done: Column, w: Column) -> Column:
        """Words of the name one after the other; initials get a letter that the new family name and they decide."""
        byte = F.conv(F.substring(F.sha2(F.concat(F.element_at(parts, -1), w), 256), 1, 2), 16, 10).cast("int")
        letters = F.regexp_replace(w, "[A-Z]", F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), byte % 26 + 1, F.lit(1)))
        same = F.when(w.rlike(rf"^{_INITIALS}$"), letters).otherwise(w)
        return F.when(_stays(w) | w.rlike(r"^\s"), F.struct(F.concat(done["text"], same).alias("text"), done["at"].alias("at"))).otherwise(F.struct(F.concat(done["text"], F.initcap(parts[done["at"]])).alias("text"), (done["at"] + 1).alias("at")))

    name = F.concat(title, F.aggregate(_words(entity), begin, spell, lambda d: d["text"]), F.regexp_extract(entity, OWNER, 0))
    shouted = (kind != "token") & (F.upper(entity) == entity) & entity.rlike(r"\p{L}")
    plain = F.when(shouted, F.upper(first)).otherwise(first)
    return F.when(kind == "name", name).when(kind.isin("email", "ip", "ipv6", "token"), plain).otherwise(formatted)


def replace_personal_data(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with text_col without personal data, n_entities and surrogates.

    Found are e-mail addresses, account, phone, card and social security numbers, IP
    addresses, secret tokens, names after a title in the scripts of ``SCRIPTS``, and
    where their parts stand again as words of the same text, each part for itself.
    A name has any number of parts, with particles, which stay, and initials, which get other
    letters; addresses of one mail domain share their new one; a phone number is that of its country.
    surrogates lists what was put in, in order.  Of a phone or account number the
    country stays, of a name the title, of a token its service's prefix and the case
    of each place; cards and accounts get valid check digits.  A given name, one
    throughout the corpus, keeps the gender of its titles, a word its script, a number
    its format.  Names without any title in their text are not found.
    ``key`` decides the surrogates: the same key and corpus give the same ones.

    Null and empty texts stay, with n_entities 0.  Texts of any length are searched
    whole.  Repeated rows get the same surrogates.  Input columns named n_entities or
    surrogates are replaced.
    """
    prepare(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    maybe = text.rlike(MAYBE) | text.rlike(MAYBE_NAME)
    entities = F.when(maybe, F.regexp_extract_all(text, F.lit(ALL), F.lit(0)))
    scanned = written(docs.withColumn("__entities", F.coalesce(entities, F.array().cast("array<string>"))), "scanned")  # each text is searched once
    clean = with_results(scanned.where(F.size("__entities") == 0).drop("__entities"), {"n_entities": F.lit(0).cast("long"), "surrogates": F.array().cast("array<string>")})

    held = scanned.where(F.size("__entities") > 0).withColumns({"__gaps": F.split(text, ALL, -1), "__row": F.monotonically_increasing_id()})
    held = written(held, "with-entities")
    found = held.select("__row", F.posexplode("__entities").alias("pos", "entity")).withColumn("kind", _kind(F.col("entity")))
    # The words of a name that are replaced are worked out once, which keeps the plan short.
    found = found.withColumn("names", F.when(F.col("kind") == "name", F.filter(_words(F.col("entity")), lambda w: ~_stays(w) & ~w.rlike(r"^\s"))))
    parts = found.select("__row", "pos", "entity", F.col("kind").alias("whole"), F.posexplode(_parts(F.col("entity"), F.col("kind"), F.col("names"))).alias("nth", "part"))
    parts = written(_one_gender(parts.select("__row", "pos", "entity", "whole", "nth", "part.*")), "entities")
    table = surrogate_table(parts.select("kind", "canon").distinct(), key)
    # A name that is both given and family name is, without a title, the family name.
    names = parts.where("whole = 'name'").join(table, ["kind", "canon"]).groupBy("__row", "canon").agg(F.max_by("surrogate", "kind").alias("surrogate"))
    names = names.groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("canon", "surrogate"))).alias("__names"))
    put = parts.join(table, ["kind", "canon"]).groupBy("__row", "pos", "entity", "whole").agg(F.array_sort(F.collect_list(F.struct("nth", "surrogate"))).alias("parts"))
    put = put.select("__row", "pos", _rendered(F.col("entity"), F.col("whole"), F.col("parts.surrogate")).alias("surrogate"))
    put = put.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("pos", "surrogate"))).alias("__put"))
    joined = held.join(put, "__row").join(names, "__row", "left")
    given = lambda s: F.when(s.isNotNull(), F.array(F.struct(s.alias("text"), F.lit(True).alias("put")))).otherwise(F.array())
    pieces = F.flatten(F.zip_with("__gaps", "__put.surrogate", lambda g, s: F.concat(_mentions(g, F.col("__names")), given(s))))
    joined = joined.withColumn("__pieces", pieces).withColumn("__new", F.filter("__pieces", lambda p: p["put"])["text"])
    done = with_results(joined, {text_col: F.array_join(F.col("__pieces")["text"], ""), "n_entities": F.size("__new").cast("long"), "surrogates": F.col("__new")})
    return clean.unionByName(done.select(clean.columns))
