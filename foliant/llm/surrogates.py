"""PII surrogates: detected entities receive keyed replacements of the same type, gender, script and format.

DataFrame functions only.

1. A pattern finds e-mail addresses, IPv4 addresses, phone and card numbers, social security numbers, access
   keys, passwords, and names: after a title, or before one in scripts that put it there. Documents with mentions are
   written once, split into gaps and mentions; the others are read again and pass through.
2. A mention has a canonical form (digits of a number, lower-cased address, surname), so that its variants
   are one entity: coreference holds over the whole corpus.
3. Each distinct entity gets a surrogate from SHA-512 of key, type, canonical form and attempt. Letters map to
   letters of their script, digits to digits; card numbers keep their Luhn status and first digit, IP addresses
   the first octet, phone numbers their country code, e-mail addresses the top-level domain. Given names come
   from a list for gender and script, or are redrawn in their script where there is no list.
4. Collision check: a surrogate that two entities share, or that is itself an entity of the corpus, stays with
   the first and is drawn again, with the next attempt, for the others, until all are distinct. Short values can
   run out of free ones: after ATTEMPTS draws a surrogate gets longer by a character with each further attempt
   (IP addresses: three-digit octets), and is checked like the others.
5. Surrogates are written in the format of each mention (punctuation, case, length).

Mentions meet the table of surrogates one by one, in a join that Spark splits where one entity is very frequent; no
text is shuffled but those of documents with mentions.

Cases: a null text stays null, an empty one empty. Rows are matched by a hash of doc_id and text, so null or
repeated doc_ids do no harm, and repeated rows come out alike. Patterns have no loops over groups without a bound,
which would exhaust the stack on long input; very long texts and mentions take time in proportion. A host name of more
than 31 labels is replaced up to there. Extra columns pass through replaced(), whatever their names; one called
n_entities is replaced. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import file_count, forget, free, input_bytes, saved, table

#: The key of the registered query, whose rows must not depend on who runs it. Callers of replaced() give their own;
#: surrogates can be linked to what they stand for by whoever knows it.
QUERY_KEY = "a key for tests, not for use"
BROADCAST_ROWS = 200_000

MALE = "Mr|Herr|Hr|Sr|Señor|Monsieur|M|Signor|г-н|господин|κ|κύριος|Κύριος|السيد|מר"
FEMALE = "Mrs|Ms|Miss|Frau|Fr|Sra|Srta|Señora|Señorita|Mme|Mlle|Madame|Signora|г-жа|госпожа|κα|κυρία|Κυρία|السيدة|גברת"
NEUTRAL = "Dr|Prof|Mx"
#: Titles that follow the name, and common Chinese and Korean surnames, which tell where a name begins.
AFTER_MALE, AFTER_FEMALE = "先生", "女士|小姐"
SURNAMES = "王李张刘陈杨黄赵周吴徐孙朱马胡郭林何高梁郑罗宋谢唐韩曹许邓萧冯曾程蔡彭潘袁于董余苏叶吕魏蒋田杜丁沈姜范江傅钟卢汪戴崔任陆廖姚方金邱夏谭韦贾邹石熊孟秦阎薛侯雷白龙段郝孔邵史毛常万顾赖武康贺严尹钱施牛洪龚"
KOREAN_SURNAMES = "김이박최정강조윤장임한오서신권황안송전홍유고문양손배백허남심노하곽성차주우구민진나지엄채원천방공현함변염추도소석선설마길연위표명기반왕금옥육인맹제모"
UNCASED = r"\p{IsArabic}\p{IsHebrew}"
_WORD = r"\p{Lu}[\p{L}'’-]*\p{Ll}"


def _after_title() -> str:
    """A lookbehind for titles: those of one length together, so that each length is tried once."""
    by_length: dict[int, list[str]] = {}
    for title in f"{MALE}|{FEMALE}|{NEUTRAL}".split("|"):
        by_length.setdefault(len(title), []).append(title)
    return "(?:" + "|".join(rf"(?<=(?<!\p{{L}})(?:{'|'.join(own)}){dot} )" for own in by_length.values() for dot in ("", r"\.")) + ")"


_LOCAL = r"(?<![._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@"
PATTERNS = {
    "email": _LOCAL + r"[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++){0,30}\.\p{L}{2,}+",
    "ip": r"(?<!\.)(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)",
    "phone": r"(?<!\+)(?:\+\d{1,3}[ .-]?\(?\d{2,4}\)?|\(\d{3}\))[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)",
    "card": r"\d{4}(?:[ -]?\d{4}){3}(?!\d)",
    "ssn": r"\d{3}-\d{2}-\d{4}(?!\d)",
    "key": r"(?<![A-Za-z])(?:AKIA[A-Z0-9]{16}|[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![A-Za-z0-9])",
    "password": r"(?<==)(?<=(?:password|PASSWORD|Password)=)[\p{L}\p{N}]+",
    "name": rf"(?=[\p{{Lu}}{UNCASED}])(?<= ){_after_title()}(?:{_WORD}(?: {_WORD})?|[{UNCASED}]+(?: [{UNCASED}]+)?)",
    "name before": rf"[{SURNAMES}]\p{{IsHan}}{{1,2}}(?={AFTER_MALE}|{AFTER_FEMALE})|(?<!\p{{IsHan}})\p{{IsHan}}{{2,4}}(?=さん|様|氏)|(?<!\p{{IsKatakana}})\p{{IsKatakana}}{{2,10}}(?=さん|様|氏)|(?<!\p{{IsHangul}})[{KOREAN_SURNAMES}]\p{{IsHangul}}{{1,2}}(?= ?씨(?:[가는의를도에와께]|(?!\p{{IsHangul}})))",
}


def _any() -> str:
    """All patterns, by what they can begin with: a look at one or two characters rules most places out."""
    own = lambda *names: "|".join(f"(?:{PATTERNS[n]})" for n in names)
    word = rf"(?<![\p{{L}}\p{{N}}])(?=\p{{L}})(?:{own('email', 'key', 'password', 'name')})"
    number = rf"(?=[\p{{N}}+(])(?<!\d)(?:(?<![\p{{L}}\p{{N}}])(?:{own('email')})|{own('ip', 'phone', 'card', 'ssn', 'key', 'password')})"
    return rf"{word}|{number}|(?=[\u3040-\uD7A3])(?:{own('name before')})"


ANY = _any()

#: Given names by gender and script.
GIVEN = {
    ("m", "latin"): "Adrian Bruno Carl Daniel Emil Felix Georg Hugo Ivo Jonas Karl Lukas Marco Nils Oscar Paul Quentin Robert Simon Thomas Ulrich Victor Walter Xavier".split(),
    ("f", "latin"): "Anna Beatrice Clara Diana Emma Flora Greta Helena Irene Julia Katrin Laura Maria Nora Olivia Paula Rosa Sofia Teresa Ursula Vera Wanda Xenia Yvonne".split(),
    ("m", "cyrillic"): "Андрей Борис Виктор Глеб Денис Егор Иван Кирилл Леонид Максим Никита Олег Павел Роман Степан Тимур".split(),
    ("m", "greek"): "Αλέξανδρος Βασίλης Γιώργος Δημήτρης Κώστας Λευτέρης Μιχάλης Νίκος Πέτρος Σπύρος Στέλιος Χρήστος".split(),
    ("f", "greek"): "Αγγελική Άννα Βασιλική Γεωργία Δέσποινα Ελένη Ιωάννα Κατερίνα Μαρία Σοφία Χριστίνα Όλγα".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лидия Мария Нина Ольга Полина Раиса София".split(),
}
#: Letters that stand in for a letter of the same alphabet.
ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "àáâäçèéêëìíîïñòóôöùúûü", "абвгдежзийклмнопрстуфхцчшщыэюя", "αβγδεζηθικλμνξοπρστυφχψω")


def _some(first: int, last: int) -> str:
    """256 letters at most, spread over a range of code points."""
    letters = [chr(c) for c in range(first, last + 1) if chr(c).isalpha() and chr(c) == chr(c).lower()]
    return "".join(letters[:: -(-len(letters) // 256)])


#: Letters for those that are in none of ALPHABETS, by script; those of other scripts become Latin.
SCRIPTS = {
    "Latin": ALPHABETS[1], "Cyrillic": ALPHABETS[2], "Greek": ALPHABETS[3], "Armenian": _some(0x561, 0x586), "Hebrew": _some(0x5D0, 0x5EA), "Arabic": _some(0x620, 0x64A),
    "Devanagari": _some(0x904, 0x939), "Bengali": _some(0x985, 0x9B9), "Tamil": _some(0xB85, 0xBB9), "Thai": _some(0xE01, 0xE30), "Georgian": _some(0x10D0, 0x10FA),
    "Ethiopic": _some(0x1200, 0x135A), "Hiragana": _some(0x3041, 0x3096), "Katakana": _some(0x30A1, 0x30FA), "Hangul": _some(0xAC00, 0xD7A3), "Han": _some(0x4E00, 0x9FA5),
}
#: Draws in the format of the entity; later ones are longer.
ATTEMPTS = 16


def kind(m: Column) -> Column:
    """The type of a mention."""
    digits = F.length(F.regexp_replace(m, r"\D", ""))
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(m.rlike(r"^\d{4}([ -]?\d{4}){3}$"), "card")
        .when(m.rlike(r"^[+(][\d ().-]+$") & (digits >= 7), "phone")
        .when(m.rlike(rf"^({_WORD}( {_WORD})?|[{UNCASED}]+( [{UNCASED}]+)?|[\p{{IsHan}}\p{{IsKatakana}}\p{{IsHangul}}]+)$") & ~m.rlike(r"^(AKIA|[0-9a-fA-F]{32,64}$)"), "name")
        .otherwise("secret")
    )


def canonical(m: Column, k: Column) -> Column:
    return (
        F.when(k.isin("phone", "card", "ssn"), F.regexp_replace(m, r"\D", ""))
        .when(k == "name", F.lower(F.regexp_extract(m, r"\S+$", 0)))
        .otherwise(F.lower(m))
    )


def _draw(canon: Column, k: Column, attempt: Column, key: str) -> Column:
    """256 hexadecimal digits."""
    seed = F.concat_ws("|", F.lit(key), k, canon, attempt.cast("string"))
    return F.concat(F.sha2(seed, 512), F.sha2(F.concat(seed, F.lit("|")), 512))


def _value(draws: Column, i: Column) -> Column:
    """The i-th number below 256."""
    return F.conv(F.substring(draws, (i % 128) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _letter(c: Column, v: Column) -> Column:
    """Another character of the class of c."""
    pick = lambda letters: F.substring(F.lit(letters), v % len(letters) + 1, F.lit(1))
    out = F.when(c.rlike(r"\p{N}"), (v % 10).cast("string"))
    for letters in ALPHABETS:
        out = out.when(F.instr(F.lit(letters), c) > 0, pick(letters))
    out = out.when(~c.rlike(r"\p{L}"), c)
    for script, letters in SCRIPTS.items():
        out = out.when(c.rlike(rf"\p{{Is{script}}}"), pick(letters))
    return out.otherwise(pick(ALPHABETS[0]))


def _each(text: Column, draws: Column) -> Column:
    """All characters of text redrawn."""
    return F.array_join(F.transform(F.split(text, ""), lambda c, i: _letter(c, _value(draws, i))), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10; 0 for valid numbers."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")).otherwise(c.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10


def surrogate(canon: Column, k: Column, draws: Column) -> Column:
    """The canonical form of an entity's surrogate. draws: a column of _draw()."""
    tail = F.regexp_extract(canon, r"\.[^.]*$", 0)
    head = F.substring(canon, F.lit(1), F.length(canon) - F.length(tail))
    body = F.concat(F.substring(canon, 1, 1), _each(F.substring(canon, F.lit(2), F.length(canon) - 2), draws))
    right = (F.lit(10) - _luhn(F.concat(body, F.lit("0")))) % 10
    check = F.when(_luhn(canon) == 0, right).otherwise((right + 1 + _value(draws, F.lit(127)) % 9) % 10)
    octets = F.transform(F.split(canon, r"\."), lambda o, i: F.when(i == 0, o).otherwise(_value(draws, i).cast("string")))
    country = F.greatest(F.length(canon) - 10, F.lit(0))
    return (
        F.when(k == "email", F.concat(_each(head, draws), tail))
        .when(k == "ip", F.array_join(octets, "."))
        .when(k == "card", F.concat(body, check.cast("string")))
        .when(k == "phone", F.concat(F.substring(canon, F.lit(1), country), _each(F.substring(canon, country + 1, F.length(canon)), draws)))
        .when((k == "secret") & canon.rlike("^[0-9a-f]{32,64}$"), F.substring(draws, F.lit(1), F.length(canon)))
        .when((k == "secret") & canon.rlike("^akia"), F.concat(F.lit("akia"), _each(F.substring(canon, F.lit(5), F.length(canon)), draws)))
        .otherwise(_each(canon, draws))
    )


def longer(canon: Column, k: Column, attempt: int, draws: Column, more: Column) -> Column:
    """The surrogate with attempt - ATTEMPTS further characters: before an e-mail address, else at the end. more: draws too."""
    n, s = attempt - ATTEMPTS, surrogate(canon, k, draws)
    octets = F.transform(F.split(canon, r"\."), lambda o, i: ((_value(more, 2 * i) * 256 + _value(more, 2 * i + 1)) % 900 + 100).cast("string"))
    return (
        F.when(k == "ip", F.array_join(octets, "."))
        .when(k == "email", F.concat(_each(F.repeat(F.substring(canon, 1, 1), F.lit(n)), more), s))
        .otherwise(F.concat(s, _each(F.repeat(F.substring(canon, -1, 1), F.lit(n)), more)))
    )


def _letters(text: Column) -> Column:
    return F.split(text, "")


def _upper(c: Column) -> Column:
    return (c == F.upper(c)) & (c != F.lower(c))


def _like(mention: Column, s: Column) -> Column:
    """s with the mention's upper case; what s is longer by is upper case where all of the mention is."""
    head = F.substring(s, F.lit(1), F.length(mention))
    rest = F.substring(s, F.length(mention) + 1, F.length(s))
    loud = (mention == F.upper(mention)) & (mention != F.lower(mention))
    cased = F.zip_with(_letters(mention), _letters(head), lambda c, x: F.when(_upper(c), F.upper(x)).otherwise(x))
    return F.concat(F.array_join(cased, ""), F.when(loud, F.upper(rest)).otherwise(rest))


def _digits_into(mention: Column, s: Column) -> Column:
    """The digits of s at the places of the mention's digits, further ones at the end. Mentions of digits are short."""
    at = lambda i: F.length(F.regexp_replace(F.substring(mention, F.lit(1), i + 1), r"\D", ""))
    rest = F.substring(s, F.length(F.regexp_replace(mention, r"\D", "")) + 1, F.length(s))
    return F.concat(F.array_join(F.transform(_letters(mention), lambda c, i: F.when(c.rlike(r"\d"), F.substring(s, at(i), F.lit(1))).otherwise(c)), ""), rest)


def _given(mention: Column, before: Column, key: str) -> Column:
    """A given name and a blank for a mention of two words; of the gender that the title before it tells."""
    first = F.regexp_extract(mention, r"^(\S+) ", 1)
    title = F.regexp_extract(F.substring(before, -16, 16), r"([\p{L}-]+)\.? $", 1)
    seed = F.sha2(F.concat_ws("|", F.lit(key), F.lit("given"), F.lower(first)), 512)
    v = F.conv(F.substring(seed, 1, 7), 16, 10).cast("int")

    def pick(names: list[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, names)), v % len(names) + 1)

    def of(script: str) -> Column:
        return F.when(title.rlike(f"^({FEMALE})$"), pick(GIVEN["f", script])).when(title.rlike(f"^({MALE})$"), pick(GIVEN["m", script])).when(v % 2 == 0, pick(GIVEN["f", script])).otherwise(pick(GIVEN["m", script]))

    name = F.when(first.rlike(r"^\p{IsCyrillic}"), of("cyrillic")).when(first.rlike(r"^\p{IsGreek}"), of("greek")).when(first.rlike(r"^\p{IsLatin}"), of("latin"))
    redrawn = _like(first, _each(F.lower(first), F.concat(seed, seed)))
    return F.when(first == "", "").otherwise(F.concat(F.coalesce(name, redrawn), F.lit(" ")))


def written(mention: Column, before: Column, s: Column, key: str) -> Column:
    """The surrogate in the format of the mention."""
    k = kind(mention)
    surname = F.regexp_extract(mention, r"\S+$", 0)
    return (
        F.when(k.isin("phone", "card", "ssn"), _digits_into(mention, s))
        .when(k == "ip", s)
        .when(k == "name", F.concat(_given(mention, before, key), _like(surname, s)))
        .otherwise(_like(mention, s))
    )


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate) for distinct entities (kind, canon), all surrogates distinct and none an entity."""
    files = file_count(input_bytes(entities))
    entities = saved(entities.distinct(), "entities", files)
    taken = entities.select("kind", F.col("canon").alias("surrogate"))
    done, todo, attempt = None, entities, 0
    canon, k = F.col("canon"), F.col("kind")
    while True:
        drawn = todo.withColumn("draws", _draw(canon, k, F.lit(attempt), key))
        if attempt <= ATTEMPTS:
            drawn = drawn.withColumn("surrogate", surrogate(canon, k, F.col("draws")))
        else:
            drawn = drawn.withColumn("more", _draw(canon, k, F.lit(f"{attempt}+"), key)).withColumn("surrogate", longer(canon, k, attempt, F.col("draws"), F.col("more")))
        free_ones = drawn.join(taken, ["kind", "surrogate"], "left_anti")
        if done is not None:
            free_ones = free_ones.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        drawn_from, won = todo, saved(free_ones.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon")).select("kind", "canon", "surrogate"), "surrogates", files)
        done = won if done is None else done.unionByName(won)
        todo = saved(todo.select("kind", "canon").join(won, ["kind", "canon"], "left_anti"), "surrogates-todo", files)
        attempt += 1
        if attempt > 1:
            forget(drawn_from)  # the entities themselves are still looked at
        if todo.isEmpty():
            forget(todo)
            forget(entities)
            return done


def replaced(docs: DataFrame, key: str) -> DataFrame:
    """docs with the entities of text replaced, and n_entities: the mentions in each. key: the caller's secret."""
    columns = [c for c in docs.columns if c.lower() != "n_entities"]
    docs = docs.select(*columns)
    mentions, gaps, row, found = free(docs, "_mentions", "_gaps", "_row", "_found")
    split = docs.withColumn(mentions, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).where(F.size(mentions) > 0)
    split = split.withColumns({row: F.xxhash64("doc_id", "text"), gaps: F.split("text", ANY, -1)})
    some = saved(split.drop("text"), "with-mentions")
    m = F.col("m")
    once = some.select(F.col(row).alias("row"), F.col(mentions).alias("mentions")).dropDuplicates(["row"])
    each = once.select("row", F.posexplode("mentions").alias("at", "m")).withColumn("kind", kind(m)).withColumn("canon", canonical(m, F.col("kind")))
    each = saved(each.drop("m"), "mentions", file_count(input_bytes(docs)))
    known = surrogates(each.select("kind", "canon"), key)
    small = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    met = each.join(F.broadcast(known) if small else known, ["kind", "canon"])
    per_row = met.groupBy(F.col("row").alias(row)).agg(F.array_sort(F.collect_list(F.struct("at", "surrogate"))).getField("surrogate").alias(found))

    def piece(x: Column, i: Column) -> Column:
        before = F.element_at(gaps, i + 1)
        return F.concat(before, written(x, before, F.element_at(found, i + 1), key))

    text = F.concat(F.array_join(F.transform(mentions, piece), ""), F.element_at(gaps, -1))
    rebuilt = some.join(per_row, row).withColumn("text", text)
    without = docs.where(~F.coalesce(F.col("text").rlike(ANY), F.lit(False)))
    return rebuilt.select(*columns, F.size(mentions).cast("long").alias("n_entities")).unionByName(without.select(*columns, F.lit(0).cast("long").alias("n_entities")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replaced(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY)
