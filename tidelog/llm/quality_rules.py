"""Heuristic quality rules: a table of thresholds, compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import WORD_BREAK, spare, texts

#: Very common words of the corpus's four languages.
STOP_WORDS = ("the of and to in is that for it was with as by on are this be at an from "
              "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch "
              "le la les de et des en un une du est que dans pour qui au sur par avec plus "
              "el los las del y se por con no su para es al lo como").split()


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= metric <= high; null bounds are open, a null metric passes."""

    metric: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Metrics are columns of statistics(); ratios are 0 for a text without words or lines.
RULES = (
    Rule("n_words", 50, None),
    Rule("repeated_share", None, 0.5),
    Rule("mean_word_chars", 2, 12),
    Rule("symbols_per_word", None, 0.2),
    Rule("duplicate_line_share", None, 0.6),
    Rule("bullet_line_share", None, 0.9),
    Rule("ellipsis_line_share", None, 0.3),
    Rule("stop_words", 1, None),
    Rule("distinct_word_share", 0.05, None),
)


def statistics(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id and the statistics that rules may name, one row for each row of docs.

    Everything is a built-in expression over one row: no shuffle, no user function. Three-word
    windows are compared by a 64-bit hash within their document: sorted, so that a window found
    twice stands beside its equal. Null text has no words; all its statistics are zero.
    """
    low = F.col("text")
    w, h, s, d = F.col("w"), F.col("h"), F.col("s"), F.col("d")
    rows = texts(docs).withColumns({
        "w": F.array_remove(F.split(low, WORD_BREAK), ""),
        "lines": F.filter(F.split(low, "\n"), lambda x: x.rlike(r"[^ \t-\r]")),
    })
    windows = F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    rows = rows.withColumn("h", F.when(F.size(w) >= 3, windows))
    rows = rows.withColumn("s", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(h)))
    rows = rows.withColumn("d", F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i + 1))))
    # where repeated windows start: looked up if they are few kinds, else by sorting (hash, start)
    few = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.array_contains(d, F.get(h, i)))
    rows = rows.withColumn("t", F.when(F.size(d) > 32, F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    t = F.col("t")
    many = F.sort_array(F.transform(F.filter(t, lambda e, k: (e["x"] == F.get(t, k + 1)["x"]) | (e["x"] == F.get(t, F.greatest(k - 1, F.lit(0)))["x"]) & (k > 0)), lambda e: e["i"]))
    rows = rows.withColumn("p", F.when(d.isNull(), F.array().cast("array<int>")).when(F.size(d) > 32, many).otherwise(few))
    p = F.col("p")
    covered = F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    n, lines = F.size(w).cast("bigint"), F.size("lines").cast("bigint")

    def share(of: Column, all_: Column) -> Column:
        return F.when(all_ > 0, of / all_).otherwise(F.lit(0.0))

    symbols = F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("bigint")
    rows = rows.select(
        "doc_id", *(["text"] if keep_text else []), n.alias("n_words"), F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
        symbols.alias("n_symbols"), (lines - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"), covered.alias("n_repeat_words"),
        lines.alias("n_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"^[ \t-\r]*[-*•‣●]"))).cast("bigint").alias("n_bullet_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|…)[ \t-\r]*$"))).cast("bigint").alias("n_ellipsis_lines"),
        F.size(F.array_intersect(w, F.array(*map(F.lit, STOP_WORDS)))).cast("bigint").alias("stop_words"),
        F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct_words"),
    )
    return rows.withColumns({
        "repeated_share": share(F.col("n_repeat_words"), F.col("n_words")),
        "mean_word_chars": share(F.col("word_chars"), F.col("n_words")),
        "symbols_per_word": share(F.col("n_symbols"), F.col("n_words")),
        "duplicate_line_share": share(F.col("n_dup_lines"), F.col("n_lines")),
        "bullet_line_share": share(F.col("n_bullet_lines"), F.col("n_lines")),
        "ellipsis_line_share": share(F.col("n_ellipsis_lines"), F.col("n_lines")),
        "distinct_word_share": share(F.col("n_distinct_words"), F.col("n_words")),
    })


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """True if no rule of the table fails."""
    ok = F.lit(True)
    for r in rules:
        m = F.col(r.metric)
        if r.low is not None:
            ok = ok & F.coalesce(m >= F.lit(r.low), F.lit(True))
        if r.high is not None:
            ok = ok & F.coalesce(m <= F.lit(r.high), F.lit(True))
    return ok


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """statistics() with base_failed (under 50 words, or over half of them in repeated windows) and kept."""
    rows = statistics(docs).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return rows.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that pass, with all columns. Rows with a null doc_id go; rows sharing one stand or fall together."""
    bad = spare(docs.columns, "bad")
    judged = judge(docs, rules).groupBy("doc_id").agg(F.min("kept").alias("k")).where("k and doc_id is not null").select(F.col("doc_id").alias(bad))
    return docs.join(judged, docs["doc_id"].cast("bigint") == judged[bad], "left_semi")


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for the digest of judge(): the windows unnested and counted instead of sorted."""
    tests = []
    for r in rules:
        tests += [f"{r.metric} >= {r.low}"] if r.low is not None else []
        tests += [f"{r.metric} <= {r.high}"] if r.high is not None else []
    stop = ", ".join("'" + w + "'" for w in STOP_WORDS)
    return rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
a as (select r, doc_id, text, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) as l from d),
win as (select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select r, w, unnest(range(1, len(w) - 1)) as i from a)),
rep as (select r, i from (select r, i, count(*) over (partition by r, g) as c from win) where c > 1),
cov as (select r, count(distinct i + k) as n from rep, (values (0), (1), (2)) as o(k) group by r),
s as (select a.doc_id, len(w)::bigint as n_words, coalesce(len(array_to_string(w, '')), 0)::bigint as word_chars,
             (len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
             (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words,
             len(l) as n_lines, len(list_filter(l, lambda x: regexp_matches(x, '^[ \t\n\x0B\f\r]*[-*•‣●]'))) as bullets,
             len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t\n\x0B\f\r]*$'))) as dots,
             len(list_intersect(list_distinct(w), [{stop}])) as stop_words, len(list_distinct(w)) as n_distinct
      from a left join cov on cov.r = a.r),
m as (select *, case when n_words > 0 then n_repeat_words / n_words else 0 end as repeated_share,
             case when n_words > 0 then word_chars / n_words else 0 end as mean_word_chars,
             case when n_words > 0 then n_symbols / n_words else 0 end as symbols_per_word,
             case when n_words > 0 then n_distinct / n_words else 0 end as distinct_word_share,
             case when n_lines > 0 then n_dup_lines / n_lines else 0 end as duplicate_line_share,
             case when n_lines > 0 then bullets / n_lines else 0 end as bullet_line_share,
             case when n_lines > 0 then dots / n_lines else 0 end as ellipsis_line_share,
             n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and {' and '.join(tests)} as kept from m"""
