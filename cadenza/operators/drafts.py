"""Checking, scoring and suggesting for tables of drafts against a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import corpus as C


def issue(doc: str, line: Column, category: str, severity: str, original: Column, suggested: Column, safe: bool) -> list[Column]:
    """The columns of a suggestions table."""
    return [F.col(doc), line.cast("int").alias("line_no"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), original.cast("string").alias("original"), suggested.cast("string").alias("suggested"), F.lit(safe).alias("auto_safe")]


def whitespace_issues(lines: DataFrame, doc: str, no: str, line: str) -> DataFrame:
    """Double spaces, else spaces at the end; both are safe to mend."""
    bad = F.contains(F.col(line), F.lit("  ")) | F.col(line).endswith(" ")
    return lines.where(bad).select(*issue(doc, F.col(no), "whitespace", "low", F.col(line), F.rtrim(F.regexp_replace(line, " {2,}", " ")), True))


def phonetic_issues(lines: DataFrame, doc: str, no: str, line: str, phonetic: DataFrame) -> DataFrame:
    """Words that a dictionary (spelling, word) knows, by themselves or folded.

    The dictionary is a fixed dimension: it goes to every task, and texts are read once and stay where they are.
    """
    known = phonetic.groupBy("spelling").agg(F.collect_list(F.struct("word")).alias("_to"))
    by = lambda n: F.broadcast(known.select(F.col("spelling").alias(f"_s{n}"), F.col("_to").alias(f"_to{n}")))
    words = lines.select(doc, no, F.explode(T.words(F.col(line))).alias("_w"))
    told = words.join(by(1), F.col("_w") == F.col("_s1"), "left").join(by(2), T.ascii_fold(F.col("_w")) == F.col("_s2"), "left")
    found = told.select(doc, no, "_w", F.explode(F.coalesce("_to1", "_to2")).alias("_d"))
    return found.select(*issue(doc, F.col(no), "phonetic", "medium", F.col("_w"), F.col("_d.word"), False))


def label_issues(lines: DataFrame, doc: str, no: str, line: str) -> DataFrame:
    """Label lines whose dash lacks its space (safe to mend), and those, so mended, that have a canonical form.

    A performer alone is only flagged: which section it stands for is a guess.
    """
    raw = F.regexp_extract(line, r"^\[(.+?)\]\s*$", 1)
    labels = lines.where(raw != "").withColumn("_raw", raw).withColumn("_dash", raw.rlike(r" -\S")).withColumn("_mended", F.when(F.col("_dash"), T.dash_spaced(raw)).otherwise(raw))
    named = labels.withColumn("_to", T.canonical_label(F.col("_mended")))
    bracket = lambda c: F.concat(F.lit("["), F.col(c), F.lit("]"))
    dashes = labels.where("_dash").select(*issue(doc, F.col(no), "label", "low", bracket("_raw"), bracket("_mended"), True))
    other = named.where("_to is not null and _to <> _raw")
    severity = F.when(F.lower(F.trim("_raw")).isin(*T.PERFORMERS) & ~F.col("_dash"), "flag").otherwise("suggest")
    return dashes.unionByName(other.select(*issue(doc, F.col(no), "label_form", "suggest", bracket("_mended"), bracket("_to"), False), severity.alias("_s")).withColumn("severity", F.col("_s")).drop("_s"))


def all_issues(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def issue_counts(issues: DataFrame, doc: str) -> DataFrame:
    return issues.groupBy(doc, "category").agg(F.count("*").alias("n"), F.count_if(F.col("auto_safe")).alias("safe"))


def apply_fixes(drafts: DataFrame, issues: DataFrame, doc: str, text: str, safe_only: bool = True) -> DataFrame:
    """doc, text with each line's replacements folded in, in order; lines are told apart by their number."""
    wanted = issues.where("auto_safe") if safe_only else issues
    fixes = wanted.groupBy(F.col(doc).alias("_d"), F.col("line_no").alias("_n")).agg(F.sort_array(F.collect_list(F.struct("original", "suggested"))).alias("_f"))
    lines = drafts.select(doc, F.posexplode(F.split(text, "\n")).alias("_at", "_line"))
    fixed = lines.join(fixes, (F.col(doc) == F.col("_d")) & (F.col("_at") + 1 == F.col("_n")), "left")
    folded = F.when(F.col("_f").isNull(), F.col("_line")).otherwise(F.aggregate("_f", F.col("_line"), lambda a, f: F.replace(a, f["original"], f["suggested"])))
    rows = fixed.select(doc, F.struct("_at", folded.alias("x")).alias("s"))
    return rows.groupBy(doc).agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["x"]), "\n").alias(text))


def scheme_check(schemes: DataFrame, key: str, codes: str, expected: str) -> DataFrame:
    """key, match (share of lines with the expected letter), broken (numbers of the other lines).

    ``codes``: the groups' numbers by line (1 is A).  Lines beyond the expected scheme have no letter to match and
    are broken; an empty scheme and a text without lines match in full.
    """
    wanted = F.array(*(F.lit(ord(c) - ord("A") + 1) for c in expected.upper())).cast("array<int>")
    wrong = F.filter(F.transform(F.col(codes), lambda c, k: F.when(~F.coalesce(F.get(wanted, k) == c, F.lit(False)), k + 1)), lambda k: k.isNotNull())
    n = F.size(codes)
    whole = (n <= 0) | F.lit(not expected)
    return schemes.select(key, F.when(whole, 1.0).otherwise(F.round(1 - F.size(wrong) / n, 6)).alias("match"), F.when(whole, F.array().cast("array<int>")).otherwise(wrong).alias("broken"))


def partner_lines(letters: DataFrame, key: str, no: str, letter: str) -> DataFrame:
    """Each line with the first other line of its letter (null if it is alone)."""
    w = Window.partitionBy(key, letter).orderBy(no)
    first, second = F.first(no).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.nth_value(no, 2).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return letters.select(key, no, letter, F.when(F.col(no) == first, second).otherwise(first).alias("partner"))


def baselines(metrics: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Means and population deviations of a cohort's metrics: one row a cohort."""
    return metrics.groupBy(*by).agg(*(f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))))


def draft_scores(drafts: DataFrame, base: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Many drafts at once against one cohort's row: a 0-100 score for each metric, their mean, and the weakest."""
    scored = {c: F.round(T.score100(T.zscore(F.col(c), F.col(f"{c}_mean"), F.col(f"{c}_std"))), 6).alias(f"{c}_score") for c in columns}
    out = drafts.crossJoin(F.broadcast(base)).select(key, *scored.values())  # base: one row
    total = sum((F.col(f"{c}_score") for c in columns), F.lit(0.0)) / len(columns)
    weakest = F.array_min(F.array(*(F.struct(F.col(f"{c}_score").alias("s"), F.lit(c).alias("c")) for c in columns)))["c"]
    return out.withColumn("score", F.round(total, 4)).withColumn("weakest", weakest)


def alternatives(tokens: DataFrame, group: str, form: str, k: int = 3, least: int = 2) -> DataFrame:
    """The k most frequent forms of each group (a lemma, a word class)."""
    counted = tokens.groupBy(group, form).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return C.top_k(counted, [group], [F.desc("n"), F.asc(form)], k)


# Fixed value: a word with what follows it, or what stands before a line's first word.
_PART = r"[\p{L}\p{N}_]+[^\p{L}\p{N}_]*|[^\p{L}\p{N}_]+"


def injected(lines: DataFrame, doc: str, slang: DataFrame, density: float) -> DataFrame:
    """Lines with words replaced by slang of equal length (else one shorter, one longer), most distinctive first.

    A draft gets at most int(density * words) less the slang it has; capitals and punctuation stay.  ``slang``:
    form, distinctiveness; a dimension of at most one best form for each length is joined, and its forms go to every task.
    Lines of texts that were shuffled by ``doc`` before they were cut (``corpus.dealt``) need no further shuffle.
    """
    best = slang.groupBy(F.length("form").alias("_len")).agg(F.max_by("form", F.struct("distinctiveness", "form")).alias("_form"))
    table = F.map_from_entries(F.collect_list(F.struct("_len", "_form")))
    lookup = best.agg(table.alias("_m"))  # one row
    parts = F.regexp_extract_all("line", F.lit(_PART), 0)
    # A part is a word with what follows it; only a line's first part can be without a word.
    each = lines.select(doc, "ordinal", F.posexplode(parts).alias("_at", "_p")).withColumn("_w", F.regexp_extract("_p", r"^[\p{L}\p{N}_]*", 0)).where("_w <> ''")
    has = each.join(F.broadcast(slang.select("form").distinct()), F.lower("_w") == F.col("form"), "left")
    n = F.length("_w")
    pick = F.coalesce(F.try_element_at("_m", n), F.try_element_at("_m", n - 1), F.try_element_at("_m", n + 1))
    to = has.crossJoin(F.broadcast(lookup)).withColumn("_new", F.when(F.col("form").isNull() & (n >= 3), pick))
    cased = F.when(F.col("_w").rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring("_new", 1, 1)), F.substring("_new", 2, 1000))).otherwise(F.col("_new"))
    words = to.select(doc, "ordinal", "_at", F.col("form").isNotNull().alias("_is"), F.concat(cased, F.substring("_p", n + 1, F.length("_p"))).alias("_out"))
    w = Window.partitionBy(doc)
    # Places in order first: the counts of the draft then need no sort of their own.
    placed = words.withColumn("_r", F.count("_out").over(w.orderBy("ordinal", "_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    quota = F.floor(density * F.count("*").over(w)) - F.count_if(F.col("_is")).over(w)
    chosen = placed.withColumn("_q", quota).where("_out is not null and _r <= _q").groupBy(doc, "ordinal").agg(F.collect_list(F.struct("_at", "_out")).alias("_to"))
    # Few words are replaced: only their lines are put together again.
    new = lambda p, k: F.coalesce(F.get(F.filter("_to", lambda s: s["_at"] == k), F.lit(0))["_out"], p)
    line = F.when(F.col("_to").isNull(), F.col("line")).otherwise(F.array_join(F.transform(parts, new), ""))
    return lines.select(doc, "ordinal", "line").join(chosen, [doc, "ordinal"], "left").select(doc, "ordinal", line.alias("line"), F.when(F.col("_to").isNull(), 0).otherwise(F.size("_to")).cast("long").alias("replaced"))


def flow_suggestions(sections: DataFrame, key: list[str], kind: str, mean: str, cohort: DataFrame) -> DataFrame:
    """Sections whose mean differs from their type's in the cohort by 1.5 or more: split or merge."""
    joined = sections.join(cohort.select(kind, F.col("mean").alias("_c")), kind)
    gap = F.col(mean) - F.col("_c")
    return joined.where(F.abs(gap) >= 1.5).select(*key, kind, F.when(gap > 0, "split").otherwise("merge").alias("advice"), F.round(gap, 6).alias("gap"))


def missing_types(sections: DataFrame, key: str, kind: str, template: list[str]) -> DataFrame:
    """Template types that a draft has not."""
    return sections.groupBy(key).agg(F.collect_set(kind).alias("_k")).select(key, F.explode(F.array_except(F.array(*map(F.lit, template)), "_k")).alias("missing"))


def token_annotations(lines: DataFrame, keys: list[str], lexicon: DataFrame) -> DataFrame:
    """Tokens with lemma and word class of a lexicon (form, lemma, upos); forms it has not are out of vocabulary."""
    tokens = C.tokens(lines, keys)
    return tokens.join(lexicon, F.col("token") == F.col("form"), "left").select(*keys, "position", "token", F.coalesce("lemma", F.col("token")).alias("lemma"), "upos", F.col("form").isNull().alias("is_oov"))


def entities(tags: DataFrame, key: list[str], position: str, token: str, tag: str) -> DataFrame:
    """BIO tags as entities: B- or a change of type starts one."""
    w = Window.partitionBy(*key).orderBy(position)
    kind = F.when(F.col(tag) != "O", F.substring(tag, 3, 100))
    before = F.lag(F.substring(tag, 3, 100)).over(w)
    starts = kind.isNotNull() & (F.col(tag).startswith("B-") | before.isNull() | (before != kind) | (F.lag(tag).over(w) == "O"))
    marked = tags.withColumn("_k", kind).withColumn("_n", F.sum(starts.cast("int")).over(w)).where(F.col("_k").isNotNull())
    return marked.groupBy(*key, "_n", "_k").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(position, token))), lambda s: s[token]), " ").alias("text")).select(*key, F.col("_k").alias("type"), "text")


def section_schemes(lines: DataFrame, keys: list[str], expected: str | None = None) -> DataFrame:
    """keys, line_count, detected (letters of the scheme), match_pct, broken (places from 0), rhyme_factor of each section.

    ``lines``: keys, ordinal (from 1 in its section), line, skel.  A scheme without rhymes is ``free`` and matches no
    letter; lines beyond ``expected`` have no letter and are broken.
    """
    from . import rhyme as R
    from . import suggest as S

    key = "_section"
    named = lines.withColumn(key, F.struct(*keys))
    found = S.matched(named, key).drop("first")
    codes = R.scheme(named, found, key)
    factors = R.factor(named, R.assigned(named, key), key)
    out = codes.join(factors, key)
    n = F.size("scheme")
    rows = out.select(key, n.alias("line_count"), F.col("letters").alias("detected"), "rhyme_factor", "scheme")
    wanted = F.array(*(F.lit(ord(c) - ord("A") + 1) for c in (expected or "").upper())).cast("array<int>")
    free = F.col("detected") == "free"
    wrong = F.filter(F.transform("scheme", lambda c, k: F.when(free | ~F.coalesce(F.get(wanted, k) == c, F.lit(False)), k)), lambda k: k.isNotNull())
    broken = wrong if expected else F.array().cast("array<int>")
    return rows.withColumn("broken", broken).select(*(F.col(f"{key}.{k}").alias(k) for k in keys), "line_count", "detected", F.round(100 * (1 - F.size("broken") / F.col("line_count")), 1).alias("match_pct"), "broken", "rhyme_factor")


def scheme_fixes(lines: DataFrame, checked: DataFrame, keys: list[str], expected: str, most: int = 10) -> DataFrame:
    """keys, line (place from 0), word, expected_letter, partner_skeleton, candidates for every broken line of the sections
    that have as many lines as ``expected``.

    A candidate's skeleton ends as that of the first other line of the same letter: words of that line first, then
    those of the section, but for the line's own last word.  Such a section is a row of ``len(expected)`` lines.
    """
    n = len(expected)
    partner = [next((j for j in range(n) if j != i and expected[j] == expected[i]), None) for i in range(n)]
    right = checked.where(F.col("line_count") == n).select(*keys, "broken")
    rows = lines.join(right, keys).groupBy(*keys).agg(F.first("broken").alias("_broken"), F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "line", "skel"))), lambda s: F.struct(s["line"].alias("line"), s["skel"].alias("skel"))).alias("_ls"))
    letters = lambda line: F.regexp_extract_all(line, F.lit("[a-zA-Z]+"), 0)
    with_skel = lambda line: F.transform(letters(line), lambda w: F.struct(w.alias("w"), T.skeleton(w).alias("s")))
    every = F.filter(F.flatten(F.transform("_ls", lambda x: with_skel(x["line"]))), lambda x: F.length(x["s"]) >= 2)
    rows = rows.withColumn("_all", every).withColumn("_skels", F.transform("_all", lambda x: x["s"]))
    # Words come by their skeletons in the order in which these first occur.
    ordered = F.sort_array(F.transform("_all", lambda x, k: F.struct(F.array_position(F.col("_skels"), x["s"]).alias("a"), k.alias("k"), x["w"].alias("w"), x["s"].alias("s"))))
    rows = rows.withColumn("_all", ordered).withColumn("_at", F.explode("_broken"))
    to = F.get(F.array(*(F.lit(p).cast("int") for p in partner)), F.col("_at"))
    own, other = F.get("_ls", F.col("_at"))["line"], F.get("_ls", to)
    rows = rows.withColumn("word", F.coalesce(F.try_element_at(letters(own), F.lit(-1)), F.lit(""))).withColumn("partner_skeleton", F.when(to.isNotNull(), F.right(other["skel"], F.lit(2)))).withColumn("_line", F.coalesce(other["line"], F.lit("")))
    ends = lambda s: F.endswith(s, F.col("partner_skeleton"))
    near = F.transform(F.filter(with_skel(F.col("_line")), lambda x: ends(x["s"])), lambda x: x["w"])
    far = F.transform(F.filter("_all", lambda x: ends(x["s"]) & (x["w"] != F.col("word"))), lambda x: x["w"])
    none = F.array().cast("array<string>")
    found = F.when(F.length("partner_skeleton") >= 2, F.slice(F.array_distinct(F.concat(near, far)), 1, most)).otherwise(none)
    return rows.select(*keys, F.col("_at").alias("line"), "word", F.get(F.array(*map(F.lit, expected)), F.col("_at")).alias("expected_letter"), "partner_skeleton", found.alias("candidates"))
