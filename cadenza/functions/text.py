"""Text scalars as Column expressions (whole-stage codegen; no Python on the row path)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The Serbian Cyrillic alphabet in Latin, and the folding of South Slavic letters.
CYRILLIC = dict(zip("абвгдђежзијклмнопрстћуфхцчш", "abvgdđežzijklmnoprstćufhcčš"))
CYRILLIC_TWO = {"љ": "lj", "њ": "nj", "џ": "dž"}
FOLD_TWO = {"đ": "dj", "Đ": "Dj"}
FOLD = ("čćšžČĆŠŽ", "ccszCCSZ")
TOLD = "[\u0400-\u04ff" + FOLD[0] + "".join(FOLD_TWO) + "]"  # what normalising replaces: Cyrillic letters and those to fold
WORD = r"[\p{L}\p{N}_]+"
LATIN_WORD = "[a-zA-ZÀ-ÿ]+"
VOWEL = r"[aeiou]|(?<![aeiou])r(?![aeiou])"
NO_VOWEL = r"[^aeiour]+|(?<=[aeiou])r|r(?=[aeiou])"  # all that VOWEL leaves
# Leading words of a label that is only the song's title.
TITLE_LABELS = ("tekst pesme", "tekst pjesme", "teksti", "tekste", "songtext", "paroles", "lyrics")
# Section words, folded, and their types (a dimension; callers may pass their own).
SECTION_TYPES = {
    "refren": "refren", "chorus": "refren", "refrain": "refren", "ref": "refren", "coro": "refren", "pripjev": "refren", "pripev": "refren",
    "strofa": "strofa", "verse": "strofa", "couplet": "strofa", "vers": "strofa", "part": "strofa", "stofa": "strofa", "verso": "strofa",
    "prvi": "strofa", "drugi": "strofa", "treci": "strofa", "cetvrti": "strofa", "peti": "strofa", "sesti": "strofa", "sedmi": "strofa", "osmi": "strofa", "deveti": "strofa", "deseti": "strofa",
    "bridge": "bridge", "brigde": "bridge", "prelaz": "bridge", "prijelaz": "bridge", "most": "bridge", "puente": "bridge", "breakdown": "bridge",
    "intro": "intro", "uvod": "intro", "outro": "outro", "zavrsetak": "outro", "zavrsnica": "outro",
    "prerefren": "prerefren", "predrefren": "prerefren", "pred-refren": "prerefren", "pre-chorus": "prerefren", "pre-refren": "prerefren", "pre-hook": "prerefren", "pre-coro": "prerefren", "pre-refrain": "prerefren", "build-up": "prerefren", "buildup": "prerefren",
    "postrefren": "postrefren", "post-refren": "postrefren", "post-refern": "postrefren", "post-chorus": "postrefren", "post-hook": "postrefren", "post-coro": "postrefren",
    "hook": "hook", "drop": "hook", "izgovoreno": "spoken", "improvizacija": "spoken", "interlude": "interlude", "pauza": "instrumental", "netekstualni": "instrumental",
    "call-response": "call_response", "call_response": "call_response", "calls": "call_response",
}
# Section words of drafts and of a library's export (tried as prefixes in this order), performers' words, labels of types.
DRAFT_TYPES = {
    "build-up": "prerefren", "buildup": "prerefren", "breakdown": "bridge", "call-response": "call_response", "call_response": "call_response", "calls": "call_response",
    "verse": "strofa", "chorus": "refren", "hook": "hook", "intro": "intro", "outro": "outro", "bridge": "bridge",
    "pre-chorus": "prerefren", "pre-hook": "prerefren", "post-chorus": "postrefren", "drop": "hook",
}
LIBRARY_TYPES = {
    "verse": "strofa", "chorus": "refren", "refren": "refren", "strofa": "strofa", "bridge": "bridge", "intro": "intro", "outro": "outro", "hook": "hook",
    "pre": "prerefren", "pre-chorus": "prerefren", "pre-refren": "prerefren", "post": "postrefren", "post-chorus": "postrefren", "post-refren": "postrefren",
    "drop": "hook", "spoken": "spoken", "interlude": "interlude", "instrumental": "instrumental",
}
PERFORMERS = ("male", "female", "both", "duet", "male calls", "female calls")
LIBRARY_PERFORMERS = ("female", "male", "vocal", "choir", "crowd", "ad")
TYPE_LABELS = {
    "strofa": "Strofa", "refren": "Refren", "prerefren": "Pred-Refren", "postrefren": "Post-Refren", "bridge": "Prelaz", "hook": "Hook", "intro": "Uvod", "outro": "Završetak",
    "call_response": "Call-Response", "instrumental": "Instrumentalna pauza", "interlude": "Interlude", "spoken": "Izgovoreno",
}
SECTION_PHRASES = {"instrumentalna pauza": "instrumental", "netekstualni vokali": "instrumental", "tekst iz isjecka": "interlude", "tekst iz isecka": "interlude"}


def replace_all(x: Column, pairs: dict[str, str]) -> Column:
    for a, b in pairs.items():
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def to_latin(text: Column) -> Column:
    """Serbian Cyrillic to Latin, letter by letter, with diacritics; other letters stay."""
    two = CYRILLIC_TWO | {k.upper(): v.capitalize() for k, v in CYRILLIC_TWO.items()}
    keys, values = "".join(CYRILLIC), "".join(CYRILLIC.values())
    return F.translate(replace_all(text, two), keys + keys.upper(), values + values.upper())


def ascii_fold(text: Column) -> Column:
    return F.translate(replace_all(text, FOLD_TWO), *FOLD)


def normalize(text: Column) -> Column:
    """Cyrillic to Latin, folded, lower case; null stays null.  Compose first (``nfc``) where marks may be apart."""
    told = F.when(text.rlike(TOLD), ascii_fold(to_latin(text))).otherwise(text)  # few texts have letters to replace
    return F.lower(told)


def clean_lyrics(text: Column) -> Column:
    """Latin letters, one kind of line end, no outer spaces."""
    return F.trim(F.replace(to_latin(text), F.lit("\r\n"), F.lit("\n")))


#: Rows of an Arrow batch of texts or pages, each of some kilobytes.
BATCH_ROWS = 500


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session sends Python at most ``BATCH_ROWS`` rows at once: what a worker holds of texts and its results
    does not grow with the rows of a partition."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def nfc():
    """Unicode composition, which Spark has not: an Arrow UDF; apply it to rows that match ``\\p{M}``."""
    import unicodedata

    @F.pandas_udf("string")
    def compose(x):
        return x.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")

    return compose


def script(text: Column) -> Column:
    return F.when(text.rlike("[А-Яа-яЁё]"), "cyrillic").otherwise("latin")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def latin_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(LATIN_WORD), 0)


def syllables(text: Column) -> Column:
    """Vowels, and r that stands between no vowels."""
    return F.regexp_count(F.lower(text), F.lit(VOWEL))


def vowel_groups(text: Column) -> Column:
    """Groups of vowels in each a-z word, at least one a word."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), 0)
    return F.aggregate(F.transform(found, lambda w: F.greatest(F.regexp_count(w, F.lit("[aeiou]+")), F.lit(1))), F.lit(0), lambda a, b: a + b)


def skeleton(text: Column) -> Column:
    """The syllable carriers of a text, in order."""
    return F.regexp_replace(F.lower(text), NO_VOWEL, "")


def line_skeletons(text: Column, skip: str | None = None) -> Column:
    """The skeletons of a text's non-blank lines, all cut in one pass (a line's end stands between no vowels); trimmed lines
    that match ``skip`` are left out."""
    kept_line = lambda x: (F.trim(x) != "") & ~F.trim(x).rlike(skip) if skip else F.trim(x) != ""
    kept = F.split(F.regexp_replace(normalize(text), NO_VOWEL.replace("[^aeiour]", r"[^aeiour\n]"), ""), "\n")
    return F.filter(F.zip_with(F.split(text, "\n"), kept, lambda x, skel: F.when(kept_line(x), skel)), lambda skel: skel.isNotNull())


def end_rhyme(skel: Column, n: int) -> Column:
    return F.right(skel, F.lit(n))


def last_word(line: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(F.lower(line), F.lit("[a-z]+"), 0), F.lit(-1))


def key_part(text: Column) -> Column:
    """Only a-z and 0-9 of the normalised text: what titles are compared by."""
    return F.regexp_replace(normalize(text), "[^a-z0-9]", "")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(normalize(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def safe_slug(name: Column, limit: int = 50) -> Column:
    """A file name's slug of at most ``limit`` characters; a trailing ``[id].ext`` stays whole."""
    tail = F.regexp_extract(name, r"(\[[^\]]+\]\.\w+)$", 1)
    head = F.substring(name, F.lit(1), F.length(name) - F.length(tail))
    return F.concat(F.substring(slug(head), 1, limit), tail)


def path_key(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def role_of(category: Column) -> tuple[Column, Column]:
    """(role, name before it) of a category such as ``name-solo``."""
    role = F.regexp_extract(category, r"-(featured|solo|duo|trio)$", 1)
    return F.when(role == "", None).otherwise(role), F.regexp_replace(category, r"-(featured|solo|duo|trio)$", "")


def file_parts(name: Column) -> Column:
    """date, artist, title, id of ``date - artist - title [id].ext``; with fewer parts: artist - title, or title."""
    ident = F.nullif(F.regexp_extract(name, r"\[([^\]]+)\]", 1), F.lit(""))
    bare = F.trim(F.regexp_replace(name, r"\s*(\[[^\]]+\])?\.\w+$", ""))
    parts = F.split(bare, " - ", 3)
    n = F.size(parts)
    at = lambda k: F.trim(F.get(parts, k))
    return F.struct(F.when(n == 3, at(0)).alias("date"), F.when(n == 3, at(1)).when(n == 2, at(0)).alias("artist"), F.when(n == 3, at(2)).when(n == 2, at(1)).otherwise(at(0)).alias("title"), ident.alias("id"))


def clip_id(url: Column) -> Column:
    """The last path part of a URL, without query and fragment."""
    return F.nullif(F.regexp_extract(url, r"/([^/?#]+)(?:[?#].*)?$", 1), F.lit(""))


def from_first_label(text: Column) -> Column:
    """What begins at the first line that is a [label]; the whole text if none is."""
    at = F.regexp_instr(text, F.lit(r"(?m)^\["))
    return F.when(at > 0, F.substring(text, at, F.length(text))).otherwise(text)


def blank_lines_cleaned(text: Column) -> Column:
    """Lines trimmed, blank ones dropped."""
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)


def summary(title: Column, description: Column, tags: Column, n: int = 200) -> Column:
    first = F.substring(F.get(F.split(description, "\n"), 0), 1, 100)
    return truncated(F.concat_ws(" | ", F.nullif(title, F.lit("")), F.nullif(first, F.lit("")), F.nullif(F.array_join(F.slice(tags, 1, 5), ", "), F.lit(""))), n)


def hints(text: Column, keywords: list[str], most: int) -> Column:
    """The first ``most`` of the keywords that occur in the text."""
    low = F.lower(text)
    return F.slice(F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(low, k)), 1, most)


# Pitch classes, flats as sharps.
PITCHES = {"C": 0, "C#": 1, "Db": 1, "D": 2, "D#": 3, "Eb": 3, "E": 4, "F": 5, "F#": 6, "Gb": 6, "G": 7, "G#": 8, "Ab": 8, "A": 9, "A#": 10, "Bb": 10, "B": 11}


def pitch(key: Column) -> Column:
    """0-11 of a key such as ``F#m``; null if it is none."""
    table = F.create_map(*(F.lit(v) for kv in PITCHES.items() for v in kv))
    return F.try_element_at(table, F.regexp_extract(F.trim(key), r"^([A-G][#b]?)", 1))


def semitones(a: Column, b: Column) -> Column:
    """The signed distance from key a to key b, in -5 to 6."""
    return F.pmod(pitch(b) - pitch(a) + 5, F.lit(12)) - 5


def zscore(x: Column, mean: Column, std: Column) -> Column:
    return F.when(F.coalesce(std, F.lit(0.0)) == 0, 0.0).otherwise((x - mean) / std)


def score100(z: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50 + 25 * z))


def log_ratio(a: Column, b: Column) -> Column:
    """Distinctiveness: log2 of rates with half a count more."""
    return F.log2((a + 0.5) / (b + 0.5))


def density(per_line: Column) -> Column:
    return F.when(per_line < 6, 4).when(per_line < 10, 8).otherwise(16)


def section_label(label: Column, types: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> Column:
    """type, number, performers of a section label.

    In this order: a title placeholder; a phrase; ``A/B`` (the first if known); ``Artist: Type``; then
    ``Type N: performers``, ``Type - performers`` or ``N. Type``.  Unknown and null labels are ``other``.
    """
    table = F.create_map(*(F.lit(v) for kv in (types or SECTION_TYPES).items() for v in kv))
    text = F.trim(F.coalesce(label, F.lit("")))
    folded = normalize(text)

    def people(x: Column) -> Column:
        return F.filter(F.transform(F.split(x, "[&,]"), lambda p: F.trim(p)), lambda p: p != "")

    def parsed(x: Column) -> tuple[Column, Column, Column]:
        colon, dash = F.contains(x, F.lit(":")), F.contains(x, F.lit(" - "))
        head = F.trim(F.when(colon, F.substring_index(x, ":", 1)).when(dash, F.substring_index(x, " - ", 1)).otherwise(x))
        tail = F.trim(F.when(colon, F.regexp_extract(x, r"(?s):(.*)$", 1)).when(dash, F.regexp_extract(x, r"(?s)^.*? - (.*)$", 1)).otherwise(F.lit("")))
        before = F.regexp_extract(head, r"^(\d+)\.\s*\S", 1)
        body = F.regexp_replace(head, r"^\d+\.\s*(?=\S)", "")
        word = F.regexp_extract(body, r"^([A-Za-zÀ-ɏ-]+)", 1)
        after = F.regexp_extract(body, r"^[A-Za-zÀ-ɏ-]+\s*(\d+)", 1)
        kind = F.coalesce(F.try_element_at(table, normalize(word)), F.lit("other"))
        number = F.when(word == "", None).otherwise(F.when(before != "", before).otherwise(F.nullif(after, F.lit(""))).cast("int"))
        return kind, number, people(tail)

    none = F.array().cast("array<string>")
    nothing = F.lit(None).cast("int")
    row = lambda kind, number, who: F.struct(kind.alias("type"), number.alias("number"), who.alias("performers"))
    out = F.when(text == "", row(F.lit("other"), nothing, none))
    starts = F.lit(False)
    for p in TITLE_LABELS:
        starts = starts | folded.startswith(p)
    out = out.when(starts, row(F.lit("tekst"), nothing, none))
    for phrase, kind in (phrases or SECTION_PHRASES).items():
        rest = F.substring(text, len(phrase) + 1, 10_000)
        out = out.when(folded.startswith(phrase), row(F.lit(kind), nothing, people(F.regexp_extract(rest, r"^\s*(?::|- )(.*)$", 1))))
    first, second = F.trim(F.substring_index(text, "/", 1)), F.regexp_extract(text, "(?s)/(.*)$", 1)
    kind, number, who = parsed(first)
    out = out.when(F.contains(text, F.lit("/")) & (kind != "other"), row(kind, number, F.when(F.contains(second, F.lit(":")), people(F.regexp_extract(second, "(?s):(.*)$", 1))).otherwise(who)))
    left, right = F.trim(F.substring_index(text, ":", 1)), F.trim(F.regexp_extract(text, "(?s):(.*)$", 1))
    kind, number, _ = parsed(right)
    out = out.when((right != "") & (kind != "other") & (parsed(left)[0] == "other"), row(kind, number, F.array(left)))
    return out.otherwise(row(*parsed(text)))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(v) for kv in table.items() for v in kv)), key)


def library_label(label: Column, types: dict[str, str] | None = None) -> Column:
    """Type of an exported label: the whole label, else the first section word it begins with, else a performer's word (``strofa``), else ``other``."""
    table = types or LIBRARY_TYPES
    text = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    begins = F.coalesce(*(F.when(text.startswith(k), v) for k, v in table.items()))
    performs = F.exists(F.array(*map(F.lit, LIBRARY_PERFORMERS)), lambda w: F.contains(text, w))
    return F.coalesce(_lookup(table, text), begins, F.when(performs, "strofa").otherwise("other"))


def dash_spaced(label: Column) -> Column:
    """A space after each dash that has one before it."""
    return F.regexp_replace(label, r" -(\S)", " - $1")


def canonical_label(label: Column) -> Column:
    """The canonical form of a draft's label that ``section_label`` does not know; null where there is none or it is known.

    In this order: calls and answers, ``performer - type``, a performer alone.
    """
    text = F.trim(F.coalesce(label, F.lit("")))
    low = F.lower(text)
    sides = F.filter(F.split(text, r"\s*-\s*", 2), lambda x: F.trim(x) != "")
    answers = F.concat(F.lit("Call-Response: "), F.array_join(F.transform(sides, lambda x: F.regexp_extract(F.trim(x), r"^(\S+)", 1)), " & "))
    kind = _lookup(DRAFT_TYPES, F.trim(F.lower(ascii_fold(F.trim(F.regexp_extract(text, r"(?s)^.*? - (.*)$", 1))))))
    typed = F.concat(_lookup(TYPE_LABELS, kind), F.lit(": "), F.substring_index(text, " - ", 1))
    out = F.when((text == "") | (section_label(text)["type"] != "other"), None)
    out = out.when(F.contains(low, F.lit("calls")) & F.contains(low, F.lit("answer")), answers)
    return out.when(F.contains(text, F.lit(" - ")), typed).when(low.isin(*PERFORMERS), F.concat(F.lit("Refren: "), text))


def collab_type(category: Column, featured: Column) -> Column:
    """trio, duo or featured by the category's words (lower case) in this order, or by featured artists; else solo."""
    has = lambda w: F.coalesce(F.contains(category, F.lit(w)), F.lit(False))
    return F.when(has("trio"), "trio").when(has("duo"), "duo").when(has("featured") | (F.coalesce(F.size(featured), F.lit(0)) > 0), "featured").otherwise("solo")
