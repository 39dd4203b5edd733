"""Suggestions for drafts from a corpus: vocabulary, slang, structure, flow, rhyme; many drafts at once.

Drafts are a text each, with ``[label]`` lines above their sections.  Every direction gives rows of one form
(``COLUMNS`` after the draft's key); ``run`` puts the chosen ones together.

Words are resolved once for each distinct form, not for each place, so a frequent word costs one row until the last
join.  What is broadcast is bounded: one row, a row for each section type, or the ``FREQUENT`` most frequent forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import corpus as C

COLUMNS = ("line_no", "direction", "category", "severity", "original", "suggested", "auto_safe")
# Word classes with content, and a draft's rare words.
CONTENT = ("NOUN", "VERB", "ADJ", "ADV", "PROPN")
RARE, SHORTEST, FREQUENT = 5, 3, 500
# The order of section types by kind of song, which types stand for each other, and their labels.
TEMPLATES = {
    "drill_trap": ["intro", "hook", "strofa", "prerefren", "hook", "strofa", "bridge", "hook", "outro"],
    "pop": ["strofa", "prerefren", "refren", "strofa", "bridge", "refren", "outro"],
}
STANDS_FOR = {"refren": "hook", "hook": "refren"}
LABELS = {"intro": "[Intro]", "hook": "[Hook]", "strofa": "[Strofa]", "prerefren": "[Pred-Refren]", "refren": "[Refren]", "bridge": "[Prelaz]", "outro": "[Završetak]", "postrefren": "[Post-Refren]"}
# Mean rhyme factors where a cohort has none.
RHYME_FACTORS = {"drill_trap": 0.56, "pop": 0.74}


def _suggestion(doc: str, line_no: Column, direction: str, category: Column | str, severity: Column | str, original: Column, suggested: Column, safe: Column | bool) -> list[Column]:
    values = (line_no.cast("int"), direction, category, severity, original.cast("string"), suggested.cast("string"), safe)
    return [F.col(doc), *((v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in zip(COLUMNS, values))]


# ---- drafts ----

#: Fixed value: a line that is a section's label.
LABEL = r"^\[(.+?)\]$"


def marked(df: DataFrame, doc: str, text: str, types: dict[str, str] | None = None) -> DataFrame:
    """doc, line_no, line, is_label, section (0 above the first label), kind (``unknown`` there), ordinal (among the lines
    that are no labels) of every non-blank line."""
    each = df.select(doc, F.posexplode(F.split(text, "\n")).alias("_at", "_line")).select(doc, (F.col("_at") + 1).alias("line_no"), F.trim("_line").alias("line")).where("line <> ''")
    label = F.regexp_extract("line", LABEL, 1)
    kind = (T.section_label(label, types) if types else T.section_label(label))["type"]
    w = Window.partitionBy(doc).orderBy("line_no")
    out = each.withColumn("is_label", label != "").withColumn("_kind", F.when(F.col("is_label"), kind))
    return out.select(doc, "line_no", "line", "is_label", F.sum(F.col("is_label").cast("int")).over(w).alias("section"), F.sum((~F.col("is_label")).cast("int")).over(w).alias("ordinal"), F.coalesce(F.last("_kind", True).over(w), F.lit("unknown")).alias("kind"))


def lyric_lines(marks: DataFrame) -> DataFrame:
    return marks.where("not is_label").drop("is_label")


def sections(marks: DataFrame, doc: str) -> DataFrame:
    """doc, section, kind, line_no (of the label; 0 above the first) of every section that has a label or a line."""
    at = F.coalesce(F.min(F.when(F.col("is_label"), F.col("line_no"))), F.lit(0))
    return marks.groupBy(doc, "section", "kind").agg(at.alias("line_no"))


# ---- forms ----


def most_seen(tokens: DataFrame, form: str = "form", lemma: str = "lemma", tag: str = "upos", n: str | None = None) -> DataFrame:
    """form, lemma, upos, freq: of each form its most frequent reading, the first by name on ties.

    ``n``, here and below: how often a row occurs, if tokens are counted; one counted table then serves every step.
    """
    each = tokens.groupBy(F.col(form).alias("form"), F.col(lemma).alias("lemma"), F.col(tag).alias("upos")).agg(F.sum(n or F.lit(1)).alias("freq"))
    best = F.min(F.struct((-F.col("freq")).alias("n"), "lemma", "upos"))
    return each.groupBy("form").agg(best.alias("_b")).select("form", "_b.lemma", "_b.upos", (-F.col("_b.n")).alias("freq"))


def leaders(counted: DataFrame, group: str, order: list[Column], k: int = 2) -> DataFrame:
    """group, best: the first ``k`` rows (form, n) of each group, so that one of them is another form than any given one."""
    top = C.top_k(counted, [group], order, k, "_rank")
    return top.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("_rank", "form", "n"))), lambda s: F.struct(s["form"].alias("form"), s["n"].alias("n"))).alias("best"))


def other_than(best: str, form: Column) -> Column:
    """The first of ``best`` whose form is another."""
    return F.get(F.filter(best, lambda s: s["form"] != form), F.lit(0))


def words(lines: DataFrame, doc: str) -> DataFrame:
    """doc, line_no, word, form (folded, lower case) of the words of ``SHORTEST`` letters or more."""
    each = lines.select(doc, "line_no", F.explode(F.regexp_extract_all("line", F.lit(T.WORD), 0)).alias("word"))
    return each.withColumn("form", F.lower(T.ascii_fold(F.col("word")))).where(F.length("form") >= SHORTEST)


def _readings(mine: DataFrame, known: DataFrame) -> DataFrame:
    """``known`` of the distinct forms of drafts.  By null-safe equality: what is known of a draft's words (their length)
    then is no filter on the corpus' counts, which other steps share."""
    asked = mine.select(F.col("form").alias("_form")).distinct()
    return asked.join(known, F.col("_form").eqNullSafe(F.col("form"))).drop("form").withColumnRenamed("_form", "form")


def vocabulary(lines: DataFrame, doc: str, tokens: DataFrame, cohort: Column, least: int = 5, n: str | None = None) -> DataFrame:
    """Rare content words with the cohort's most frequent other form of their lemma (safe), else of their word class.

    ``tokens``: form, lemma, upos of the corpus; ``cohort``: which of them are the cohort's.
    """
    known = most_seen(tokens, n=n).where((F.col("freq") < RARE) & F.col("upos").isin(*CONTENT))
    own = F.sum(F.when(cohort, F.col(n) if n else F.lit(1))).alias("n")  # null of forms that the cohort lacks
    order = [F.desc("n"), F.asc("form")]
    by_lemma = leaders(tokens.groupBy("lemma", "form").agg(own).where("n > 0"), "lemma", order)
    by_tag = leaders(tokens.groupBy("upos", "form").agg(own).where(F.col("n") >= F.greatest(F.lit(least), F.lit(1))), "upos", order)
    mine = words(lines, doc)
    asked = _readings(mine, known)
    both = asked.join(by_lemma.withColumnRenamed("best", "_l"), "lemma", "left").join(by_tag.withColumnRenamed("best", "_t"), "upos", "left")
    same, fallback = other_than("_l", F.col("form")), other_than("_t", F.col("form"))
    found = both.select("form", same["form"].alias("_same"), F.coalesce(same["form"], fallback["form"]).alias("_to")).where("_to is not null")
    is_same = F.col("_same").isNotNull()
    category = F.when(is_same, "vocabulary_same_lemma").otherwise("vocabulary_upos_fallback")
    return mine.join(found, "form").select(*_suggestion(doc, F.col("line_no"), "vocabulary", category, F.when(is_same, "safe").otherwise("suggest"), F.col("word"), F.col("_to"), is_same))


def distinctive(slang: DataFrame, positive: bool, least: float = 1.0) -> DataFrame:
    """form, folded, distance of a cohort's slang: over ``least`` on its side, of equal folded forms the most distinctive."""
    d = F.col("distinctiveness")
    mine = slang.where(d > least if positive else d < -least).select("form", F.lower(T.ascii_fold(F.col("form"))).alias("folded"), F.abs(d).alias("distance"))
    best = mine.groupBy("folded").agg(F.min(F.struct((-F.col("distance")).alias("d"), "form")).alias("_b"))
    return best.select("_b.form", "folded", (-F.col("_b.d")).alias("distance"))


def slang_by_tag(slang: DataFrame, known: DataFrame) -> DataFrame:
    """upos, best: the two most distinctive slang words whose folded form is mostly seen as that word class."""
    tagged = slang.join(known.select(F.col("form").alias("folded"), "upos"), "folded")
    named = tagged.select("upos", "form", F.col("distance").alias("n"))
    return leaders(named, "upos", [F.desc("n"), F.asc("form")])


def slang(lines: DataFrame, doc: str, tokens: DataFrame, terms: DataFrame, positive: bool = True, n: str | None = None) -> DataFrame:
    """Content words that are no slang, with the most distinctive slang of their word class."""
    known, mine, dear = most_seen(tokens, n=n), words(lines, doc), distinctive(terms, positive)
    best = slang_by_tag(dear, known)
    asked = _readings(mine, known.where(F.col("upos").isin(*CONTENT))).join(dear.select("folded"), F.col("form").eqNullSafe(F.col("folded")), "left_anti")
    found = asked.join(best, "upos").select("form", F.get("best", F.lit(0))["form"].alias("_to"))
    return mine.join(found, "form").select(*_suggestion(doc, F.col("line_no"), "slang", "slang_injection", "suggest", F.col("word"), F.col("_to"), False))


# ---- structure and flow ----


def common_sequences(parts: DataFrame, doc: str, k: int = 5) -> DataFrame:
    """sequence, n: the ``k`` most frequent sequences of section types, the first by name on ties."""
    each = parts.groupBy(doc).agg(F.transform(F.sort_array(F.collect_list(F.struct("section", "kind"))), lambda s: s["kind"]).alias("sequence"))
    return each.groupBy("sequence").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "sequence").limit(k)


def structure(parts: DataFrame, doc: str, template: list[str], cohort: DataFrame | None = None) -> DataFrame:
    """Types of the template that a draft lacks, sections ahead of what should precede them, drafts far shorter than a
    cohort's common sequences (``cohort``: of ``common_sequences``).  Labels alone change, so all are safe."""
    first = {k: template.index(k) for k in template}
    place = F.lit(None).cast("int")
    for k in sorted({*first, *STANDS_FOR}):
        at = first.get(STANDS_FOR.get(k, k), first.get(k))
        if at is not None:
            place = F.when(F.col("kind") == k, at).otherwise(place)
    w = Window.partitionBy(doc).orderBy("section")
    placed = parts.withColumn("_i", F.row_number().over(w)).withColumn("_place", place)
    placed = placed.withColumn("_most", F.max("_place").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    late = placed.where("_place < _most").select(*_suggestion(doc, F.col("line_no"), "structure", "structure_ordering", "suggest", F.concat("kind", F.lit(" at position "), F.col("_i")), F.concat(F.lit("Move after position "), F.col("_most") + 1, F.lit(" in template order")), True))
    # Which of the template's few types a draft has, and how many sections.
    has = parts.groupBy(doc).agg(F.count("*").alias("_n"), *(F.max((F.col("kind") == k).cast("int")).alias(f"_has_{k}") for k in first))
    lacks = F.filter(F.array(*(F.when(F.col(f"_has_{k}") == 0, F.lit(LABELS.get(k, f"[{k.capitalize()}]"))) for k in first)), lambda x: x.isNotNull())
    missing = has.select(doc, F.explode(lacks).alias("_label")).select(*_suggestion(doc, F.lit(0), "structure", "structure_missing_section", "safe", F.lit("(missing)"), F.col("_label"), True))
    out = late.unionAll(missing)
    if cohort is not None:
        mean = cohort.agg(F.round(F.avg(F.size("sequence")), 1).alias("_mean"))  # one row
        few = has.crossJoin(F.broadcast(mean)).where(F.col("_n") < F.col("_mean") - 2)
        out = out.unionAll(few.select(*_suggestion(doc, F.lit(0), "structure", "structure_count_mismatch", "suggest", F.concat("_n", F.lit(" sections")), F.concat(F.lit("~"), F.bround("_mean", 0).cast("int"), F.lit(" sections (cohort average)")), True)))
    return out


def estimated_syllables(line: Column) -> Column:
    """Groups of vowels in each word, at least one a word."""
    found = F.regexp_extract_all(F.lower(line), F.lit(T.WORD), 0)
    return F.aggregate(F.transform(found, lambda w: F.greatest(F.regexp_count(w, F.lit("[aeiou]+")), F.lit(1))), F.lit(0), lambda a, b: a + b)


def flow_shape(rows: DataFrame, keys: list[str], order: str, x: str) -> DataFrame:
    """keys, n, mean, pattern: uniform (all within 1 of the mean), alternating (every other line 3 or more apart, each
    within 2 of its own mean), accelerating, decelerating (steps of 1 back at most, as far in all as there are lines), free."""
    w = Window.partitionBy(*keys).orderBy(order)
    each = rows.withColumn("_odd", F.row_number().over(w) % 2 == 0).withColumn("_d", F.col(x) - F.lag(x).over(w))
    a, b = F.when(~F.col("_odd"), F.col(x)), F.when(F.col("_odd"), F.col(x))
    g = each.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(x).alias("_m"), F.min(x).alias("_lo"), F.max(x).alias("_hi"), *(f(c).alias(f"_{n}{s}") for s, c in (("a", a), ("b", b)) for n, f in (("m", F.avg), ("lo", F.min), ("hi", F.max))), F.min("_d").alias("_dlo"), F.max("_d").alias("_dhi"), F.sum("_d").alias("_all"))
    near = lambda s, d: (F.col(f"_hi{s}") - F.col(f"_m{s}") <= d) & (F.col(f"_m{s}") - F.col(f"_lo{s}") <= d)
    kind = F.when((F.col("n") == 1) | near("", 1), "uniform").when((F.col("n") >= 4) & (F.abs(F.col("_ma") - F.col("_mb")) >= 3) & near("a", 2) & near("b", 2), "alternating")
    kind = kind.when((F.col("_dlo") >= -1) & (F.col("_all") >= F.col("n")), "accelerating").when((F.col("_dhi") <= 1) & (F.col("_all") <= -F.col("n")), "decelerating").otherwise("free")
    return g.select(*keys, "n", F.col("_m").alias("mean"), kind.alias("pattern"))


def flow(lines: DataFrame, doc: str, cohort: DataFrame) -> DataFrame:
    """Sections whose mean syllables differ from the cohort's by 1.5 or more, or whose pattern is unlike the cohort's.

    ``cohort``: kind, syllables of its lines.  A type that the cohort lacks is held against the mean of all.
    """
    counted = lines.withColumn("_x", estimated_syllables(F.col("line")))
    shape = flow_shape(counted, [doc, "section", "kind"], "line_no", "_x").where("n >= 2")
    first = lines.groupBy(doc, "section", "kind").agg(F.min("line_no").alias("line_no"))
    s = F.col("syllables")
    by_kind = cohort.groupBy("kind").agg(F.avg(s).alias("_mean"), F.avg(s * s).alias("_sq"))  # a row for each type
    every = cohort.agg(F.round(F.avg(s), 2).alias("_every"))  # one row
    variance = F.col("_sq") - F.col("_mean") * F.col("_mean")
    cv = F.when(F.col("_mean") > 0, F.when(variance > 1e-9, F.sqrt(variance) / F.col("_mean")).otherwise(0.0))
    joined = shape.join(first, [doc, "section", "kind"]).join(F.broadcast(by_kind), "kind", "left").crossJoin(F.broadcast(every))
    joined = joined.withColumn("_u", F.round("mean", 2)).withColumn("_c", F.coalesce(F.round("_mean", 2), "_every")).withColumn("_cv", cv)
    gap = F.round(F.col("_u") - F.col("_c"), 2)
    number = lambda c: F.format_string("%.2f", c)
    far = joined.where((F.col("_c") > 0) & (F.abs(gap) >= 1.5))
    action = F.when(gap > 0, " syllables/line (split)").otherwise(" syllables/line (merge)")
    out = far.select(*_suggestion(doc, F.col("line_no"), "flow", "flow_syllable_count", "suggest", F.concat(number("_u"), F.lit(" syllables/line")), F.concat(number("_c"), action), False))
    flat = joined.where("pattern = 'uniform' and n >= 3 and _cv > 0.15 or pattern = 'alternating' and _cv < 0.05")
    to = F.when(F.col("pattern") == "uniform", "alternating or varied").otherwise("uniform")
    return out.unionAll(flat.select(*_suggestion(doc, F.col("line_no"), "flow", "flow_pattern_mismatch", "suggest", F.col("pattern"), to, False)))


# ---- rhyme ----


def matched(lines: DataFrame, key: str, n: int = 2) -> DataFrame:
    """key, ordinal, suffix, match_length, first of the lines whose last n skeleton letters another line has; ``first``
    is the group's first line."""
    rows = lines.where(F.length("skel") >= n).select(key, "ordinal", F.right("skel", F.lit(n)).alias("suffix"))
    groups = rows.groupBy(key, "suffix").agg(F.min("ordinal").alias("first"), F.count("*").alias("_n")).where("_n >= 2").drop("_n")
    return rows.join(groups, [key, "suffix"]).select(key, "ordinal", "suffix", F.lit(n).alias("match_length"), "first")


def nearest_group(lines: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Lines without a group with the suffix of the nearest line that has one; of two as near, the group that begins first.

    One sort each way over a text's lines; nothing is paired.
    """
    all_ = lines.join(found.select(key, "ordinal", "suffix", "first"), [key, "ordinal"], "left")
    mark = F.when(F.col("suffix").isNotNull(), F.struct("ordinal", "first", "suffix"))
    down, up = Window.partitionBy(key).orderBy("ordinal"), Window.partitionBy(key).orderBy(F.desc("ordinal"))
    near = all_.withColumn("_a", F.last(mark, True).over(down)).withColumn("_b", F.last(mark, True).over(up)).where("suffix is null")
    side = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("ordinal") - F.col(f"{c}.ordinal")).alias("distance"), F.col(f"{c}.first").alias("first"), F.col(f"{c}.suffix").alias("suffix")))
    best = F.least(side("_a"), side("_b"))
    return near.withColumn("_n", best).drop("suffix", "first", "_a", "_b").where("_n is not null").withColumns({"suffix": F.col("_n.suffix"), "distance": F.col("_n.distance")}).drop("_n")


def rhyme_words(counted: DataFrame, form: str, n: str, letters: int = 2, k: int = FREQUENT) -> DataFrame:
    """suffix, best: of the ``k`` most frequent forms those whose skeleton ends so, most frequent first.  At most ``k`` words."""
    top = counted.select(F.col(form).alias("form"), F.col(n).alias("n")).orderBy(F.desc("n"), "form").limit(k)
    named = top.withColumn("folded", F.lower(T.ascii_fold(F.col("form")))).withColumn("_s", T.skeleton(F.col("folded"))).where(F.length("_s") >= letters)
    best = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("_o"), "form", "folded"))), lambda s: F.struct(s["form"].alias("form"), s["folded"].alias("folded"), (-s["_o"]).alias("n")))
    return named.groupBy(F.right("_s", F.lit(letters)).alias("suffix")).agg(best.alias("best"))


def isolated_lines(lines: DataFrame, key: str, words_: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Lines that rhyme with none, with a word for their end that rhymes with the nearest group.

    ``lines``: key, ordinal, line_no, line, skel; ``words_``: of ``rhyme_words``.
    """
    near = nearest_group(lines, matched(lines, key) if found is None else found, key)
    last = F.try_element_at(F.regexp_extract_all("line", F.lit(T.WORD), 0), F.lit(-1))
    named = near.withColumn("_last", last).where("_last is not null").join(F.broadcast(words_), "suffix", "left")  # at most FREQUENT words
    folded = F.lower(T.ascii_fold(F.col("_last")))
    to = F.get(F.filter("best", lambda s: s["folded"] != folded), F.lit(0))["form"]
    return named.select(*_suggestion(key, F.col("line_no"), "rhyme", "rhyme_isolated_line", "suggest", F.col("_last"), F.coalesce(to, F.concat(F.lit("(word with vowel skeleton '"), F.col("suffix"), F.lit("')"))), False))


def low_density(factors: DataFrame, key: str, cohort: DataFrame, otherwise: float) -> DataFrame:
    """Drafts whose rhyme factor is below the mean of the cohort's (``cohort``: rhyme_factor a song; without any, ``otherwise``)."""
    mean = cohort.agg(F.coalesce(F.round(F.avg("rhyme_factor"), 4), F.lit(otherwise)).alias("_mean"))  # one row
    low = factors.crossJoin(F.broadcast(mean)).where("rhyme_factor < _mean")
    factor = lambda c: F.concat(F.lit("RF="), F.format_string("%.4f", c))
    return low.select(*_suggestion(key, F.lit(0), "rhyme", "rhyme_factor_low", "flag", factor("rhyme_factor"), F.concat(factor("_mean"), F.lit(" (cohort median)")), False))


def paired(codes: str) -> Column:
    """Whether a scheme has two pairs of lines side by side (AABB) at an even place."""
    at = lambda i: F.get(codes, i)
    places = F.when(F.size(codes) >= 4, F.sequence(F.lit(0), F.size(codes) - 4, F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.exists(places, lambda i: (at(i) == at(i + 1)) & (at(i + 2) == at(i + 3)) & (at(i) != at(i + 2)))


def scheme_upgrades(schemes: DataFrame, key: str) -> DataFrame:
    """Drafts of consecutive pairs, which could alternate.  ``schemes``: key, scheme (group numbers by line), letters."""
    return schemes.where(paired("scheme")).select(*_suggestion(key, F.lit(0), "rhyme", "rhyme_scheme_upgrade", "suggest", F.col("letters"), F.lit("ABAB with internal rhymes"), False))


# ---- all of them ----


def draft_metrics(lines: DataFrame, key: str) -> DataFrame:
    """A row a draft: words, distinct words, ttr, lines, rhyme factor, rhyme scheme, lines that rhyme with none.

    ``lines``: key, ordinal, line, skel.  A draft's distinct words are counted in its own group.
    """
    from . import rhyme as R

    words_ = F.regexp_extract_all(F.lower("line"), F.lit(T.WORD), 0)
    sized = lines.groupBy(key).agg(F.count("*").alias("line_count"), F.sum(F.size(words_)).alias("word_count"))
    unique = lines.select(key, F.explode(words_).alias("w")).distinct().groupBy(key).agg(F.count("*").alias("unique_words"))
    found = matched(lines, key)
    rhymed = found.groupBy(key).agg(F.count("*").alias("_rhymed"))
    schemes = R.scheme(lines, found.drop("first"), key).select(key, F.col("letters").alias("rhyme_scheme"))
    factors = R.factor(lines, R.assigned(lines, key), key)
    out = sized.join(unique, key, "left").join(rhymed, key, "left").join(schemes, key, "left").join(factors, key, "left")
    n = F.coalesce("unique_words", F.lit(0))
    return out.select(key, "word_count", n.alias("unique_words"), F.when(F.col("word_count") > 0, F.round(n / F.col("word_count"), 4)).alias("ttr"), "line_count", "rhyme_factor", "rhyme_scheme", (F.col("line_count") - F.coalesce("_rhymed", F.lit(0))).alias("isolated_lines"))


def run(parts: dict[str, DataFrame], directions: list[str], doc: str) -> tuple[DataFrame, DataFrame]:
    """(suggestions of the chosen directions with their ``place`` in a draft, by line and direction; counts by category,
    with the rows ``total`` and ``auto_safe``)."""
    chosen = [parts[d] for d in directions if d in parts]
    if not chosen:
        raise ValueError("no direction is known")
    out = chosen[0]
    for df in chosen[1:]:
        out = out.unionAll(df)
    w = Window.partitionBy(doc).orderBy("line_no", "direction", "category", "original", "suggested")
    named = F.explode(F.filter(F.array(F.col("category"), F.lit("total"), F.when(F.col("auto_safe"), "auto_safe")), lambda c: c.isNotNull()))
    return out.withColumn("place", F.row_number().over(w)), out.select(doc, named.alias("category")).groupBy(doc, "category").agg(F.count("*").alias("n"))


def report(metrics: DataFrame, counts: DataFrame, benchmarks: DataFrame, doc: str) -> DataFrame:
    """A row a draft: its metrics, its counts as a map, and the cohort's benchmarks (one row)."""
    each = counts.groupBy(doc).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "n")))).alias("stats"))
    return metrics.join(each, doc, "left").crossJoin(F.broadcast(benchmarks))
