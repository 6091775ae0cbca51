"""Quality rules by weak supervision, in DataFrame functions only.

Rules look at counts of a text and vote good (1), bad (-1) or abstain (0). Expectation-maximisation
over the table of distinct vote patterns (at most 3**rules rows for any corpus) estimates how often
each rule is right about good and about bad texts; a text is kept when its posterior probability of
being good is at least a half. No single rule decides.

Edges: a null or empty text has zero counts, fails the base test and is not kept; repeated rows are
judged alike; an empty table gives an empty result; further columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, materialise

SYMBOLS = "#*$%&|<>"


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """row struct<all columns> and the counts the rules look at, one row per document.

    n_repeat_words: words covered by a 3-word window that the text holds twice or more. Windows are
    hashes; only a text that repeats one has them sorted with their places and set against their successors.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(
        F.struct("*").alias("row"),
        body.alias("body"),
        F.array_remove(F.split(body, BLANKS), "").alias("words"),
        F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    word = lambda i: F.get("words", i)
    none = F.array().cast("array<bigint>")
    hashed = F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2)))
    keyed = split.withColumn("grams", F.when(F.size("words") >= 4, hashed).otherwise(none))
    placed = F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("p"))))
    ordered = keyed.withColumn("ordered", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), placed).otherwise(F.array().cast("array<struct<g:bigint,p:int>>")))
    m = F.greatest(F.size("ordered") - 1, F.lit(0))
    twins = F.flatten(
        F.filter(
            F.zip_with(F.slice("ordered", 1, m), F.slice("ordered", 2, m), lambda a, b: F.when(a.g == b.g, F.array(a.p, b.p))),
            lambda x: x.isNotNull(),
        )
    )
    hit = ordered.withColumn("twins", F.array_distinct(twins))
    covered = F.size(F.array_distinct(F.flatten(F.transform("twins", lambda p: F.array(p, p + 1, p + 2)))))
    left = lambda pattern: F.length(F.regexp_replace("body", pattern, ""))
    times = lambda pattern: F.regexp_count("body", F.lit(pattern))
    return hit.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        left(BLANKS).cast("long").alias("word_chars"),
        times("[" + SYMBOLS + "]").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        left(r"\P{Lu}+").cast("long").alias("n_upper"),
        left(r"\P{L}+").cast("long").alias("n_letters"),
        times("[!?]").cast("long").alias("n_marks"),
        F.size(F.filter("lines", lambda x: x.rlike(r"[.!?:;\"'”»)]\s*$"))).cast("long").alias("n_closed"),
        times(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}\p{N}]++(?![^\x20\x09-\x0D])").cast("long").alias("n_bare"),
    )


def _band(value: Column, good: Column, bad: Column) -> Column:
    """1 where good holds, -1 where bad holds, 0 (abstain) between or where a count is missing."""
    return F.when(value.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0)


RULES = ("symbols", "dup_lines", "repeats", "capitals", "letters", "marks", "bare_words", "closed_lines", "word_length")


def rules() -> dict[str, Column]:
    """Name -> vote. Bounds leave a gap in which a rule abstains."""
    share = lambda a, b: F.col(a) / F.when(F.col(b) > 0, F.col(b))
    sym, dup, rep = share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")
    up, let, mark = share("n_upper", "n_letters"), share("n_letters", "word_chars"), share("n_marks", "n_words")
    bare = share("n_bare", "n_words")
    closed, mean = share("n_closed", "n_lines"), share("word_chars", "n_words")
    return {
        "symbols": _band(sym, sym <= 0.03, sym > 0.08),
        "dup_lines": _band(dup, dup <= 0.15, dup > 0.4),
        "repeats": _band(rep, rep <= 0.25, rep > 0.4),
        "capitals": _band(up, up <= 0.2, up > 0.4),
        "letters": _band(let, let >= 0.9, let < 0.75),
        "marks": _band(mark, mark <= 0.1, mark > 0.25),
        "bare_words": _band(bare, bare <= 0.05, bare > 0.2),
        "closed_lines": _band(closed, closed >= 0.6, F.lit(False)),
        "word_length": _band(mean, (mean >= 3) & (mean <= 9), (mean < 2.2) | (mean > 13)),
    }


@dataclass(frozen=True)
class LabelModel:
    """Prior of good and, for each rule, how often its vote is right on good and on bad texts."""

    prior: float = 0.85
    right_good: dict[str, float] = field(default_factory=dict)
    right_bad: dict[str, float] = field(default_factory=dict)

    def posterior(self) -> Column:
        """P(good | votes) over the vote columns v_<rule>; an abstaining rule says nothing."""
        odds = F.log(F.lit(self.prior / (1 - self.prior)))
        for name, g in self.right_good.items():
            b, vote = self.right_bad[name], F.col(f"v_{name}")
            odds = odds + F.when(vote == 1, F.log(F.lit(g / (1 - b)))).when(vote == -1, F.log(F.lit((1 - g) / b))).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def votes(counted: DataFrame) -> DataFrame:
    return counted.withColumns({f"v_{name}": vote for name, vote in rules().items()})


def fit(voted: DataFrame, rounds: int = 12, prior: float = 0.85, start: tuple[float, float] = (0.97, 0.3), weight: float = 20.0, good_bounds: tuple[float, float] = (0.9, 0.999), bad_bounds: tuple[float, float] = (0.02, 0.99)) -> LabelModel:
    """Expectation-maximisation over the vote patterns of all rows.

    Every round is one aggregate over the pattern table; `weight` pseudo-votes hold the starting
    accuracies on small tables. A rule may miss most bad texts (`bad_bounds`) but rarely hits good ones
    (`good_bounds`); the prior stays in 0.5-0.98.
    """
    names = list(RULES)
    patterns = materialise(voted.groupBy([f"v_{n}" for n in names]).count().coalesce(1), "patterns")
    model = LabelModel(prior, dict.fromkeys(names, start[0]), dict.fromkeys(names, start[1]))

    for _ in range(rounds):
        good, bad = F.col("good") * F.col("count"), (1 - F.col("good")) * F.col("count")
        sums = [F.sum(good).alias("good"), F.sum("count").alias("rows")]
        for n in names:
            vote = F.col(f"v_{n}")
            sums += [F.sum(F.when(vote == 1, good).otherwise(0.0)).alias(f"gg_{n}"), F.sum(F.when(vote != 0, good).otherwise(0.0)).alias(f"g_{n}")]
            sums += [F.sum(F.when(vote == -1, bad).otherwise(0.0)).alias(f"bb_{n}"), F.sum(F.when(vote != 0, bad).otherwise(0.0)).alias(f"b_{n}")]
        s = patterns.withColumn("good", model.posterior()).agg(*sums).first()
        if not s["rows"]:
            return model
        held = lambda hit, seen, at, span: min(span[1], max(span[0], (hit + weight * at) / (seen + weight)))
        model = LabelModel(
            min(0.98, max(0.5, s["good"] / s["rows"])),
            {n: held(s[f"gg_{n}"], s[f"g_{n}"], start[0], good_bounds) for n in names},
            {n: held(s[f"bb_{n}"], s[f"b_{n}"], start[1], bad_bounds) for n in names},
        )
    return model


def judge(counted: DataFrame, model: LabelModel, floor: float = 0.5) -> DataFrame:
    """Adds base_failed, p_good and kept."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = votes(counted).withColumn("p_good", model.posterior()).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= floor))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    counted = counts(docs).withColumn("doc_id", F.col("row.doc_id")).drop("row")
    counted = materialise(counted, "counts")  # numbers only, read by the fit and by the verdict
    return judge(counted, fit(votes(counted))).select("doc_id", *names, "base_failed", "kept", F.round("p_good", 6).alias("p_good"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base test and the label model, all columns unchanged."""
    counted = materialise(counts(docs), "counts")  # rows beside their counts: the fit reads the counts only
    return judge(counted, fit(votes(counted))).filter("kept").select("row.*")


def oracle_op9() -> str:
    """The same counts, votes and rounds of EM in SQL; rounds are unrolled over the pattern table."""
    return _oracle(12)


def _oracle(rounds: int) -> str:
    names = list(RULES)
    bands = {
        "symbols": "case when word_chars=0 then 0 when n_symbols/word_chars>0.08 then -1 when n_symbols/word_chars<=0.03 then 1 else 0 end",
        "dup_lines": "case when n_lines=0 then 0 when n_dup_lines/n_lines>0.4 then -1 when n_dup_lines/n_lines<=0.15 then 1 else 0 end",
        "repeats": "case when n_words=0 then 0 when n_repeat_words/n_words>0.4 then -1 when n_repeat_words/n_words<=0.25 then 1 else 0 end",
        "capitals": "case when n_letters=0 then 0 when n_upper/n_letters>0.4 then -1 when n_upper/n_letters<=0.2 then 1 else 0 end",
        "letters": "case when word_chars=0 then 0 when n_letters/word_chars<0.75 then -1 when n_letters/word_chars>=0.9 then 1 else 0 end",
        "marks": "case when n_words=0 then 0 when n_marks/n_words>0.25 then -1 when n_marks/n_words<=0.1 then 1 else 0 end",
        "bare_words": "case when n_words=0 then 0 when n_bare/n_words>0.2 then -1 when n_bare/n_words<=0.05 then 1 else 0 end",
        "closed_lines": "case when n_lines=0 then 0 when n_closed/n_lines>=0.6 then 1 else 0 end",
        "word_length": "case when n_words=0 then 0 when word_chars/n_words<2.2 or word_chars/n_words>13 then -1 when word_chars/n_words between 3 and 9 then 1 else 0 end",
    }
    post = lambda m: "1/(1+exp(-(ln({m}.prior/(1-{m}.prior))".format(m=m) + "".join(
        f"+case v_{n} when 1 then ln({m}.g_{n}/(1-{m}.b_{n})) when -1 then ln((1-{m}.g_{n})/{m}.b_{n}) else 0 end" for n in names
    ) + ")))"
    sql = r"""
with base as (select doc_id, coalesce(text,'') body from documents),
arr as (select doc_id, body,
  list_filter(string_split_regex(body, '[\x20\x09-\x0D]+'), lambda x: x<>'') words,
  list_filter(string_split(body, chr(10)), lambda x: length(regexp_replace(x,'[\x20\x09-\x0D]+','','g'))>0) lines from base),
win as (select doc_id, i, words[i]||' '||words[i+1]||' '||words[i+2] g from (select doc_id, words, unnest(range(1, len(words)-1)) i from arr where len(words)>=4)),
twin as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) k from win) where k>1),
cov as (select doc_id, count(distinct i+d) n from twin, (select unnest([0,1,2]) d) group by doc_id),
counted as (select doc_id, len(words) n_words, length(regexp_replace(body,'[\x20\x09-\x0D]+','','g')) word_chars,
  length(body)-length(regexp_replace(body,'[#*$%&|<>]','','g')) n_symbols,
  len(lines)-len(list_distinct(lines)) n_dup_lines, coalesce(cov.n,0) n_repeat_words, len(lines) n_lines,
  length(body)-length(regexp_replace(body,'\p{Lu}','','g')) n_upper, length(body)-length(regexp_replace(body,'\p{L}','','g')) n_letters,
  length(body)-length(regexp_replace(body,'[!?]','','g')) n_marks,
  len(list_filter(lines, lambda x: regexp_matches(x, '[.!?:;"''”»)]\s*$'))) n_closed,
  len(list_filter(words, lambda x: not regexp_matches(x, '[\p{L}\p{N}]'))) n_bare
  from arr left join cov using (doc_id)),
voted as materialized (select *, """ + ", ".join(f"{b} v_{n}" for n, b in bands.items()) + """ from counted),
pat as materialized (select """ + ", ".join(f"v_{n}" for n in names) + """, count(*) c from voted group by all),
m0 as (select 0.85::double prior, """ + ", ".join(f"0.97::double g_{n}, 0.3::double b_{n}" for n in names) + ")"
    held = lambda hit, seen, at, low, high: f"least({high}, greatest({low}, ({hit}+20*{at})/({seen}+20)))"
    for k in range(rounds):
        cols = ", ".join(
            held(f"sum(case when v_{n}=1 then p*c else 0 end)", f"sum(case when v_{n}<>0 then p*c else 0 end)", 0.97, 0.9, 0.999) + f" g_{n}, "
            + held(f"sum(case when v_{n}=-1 then (1-p)*c else 0 end)", f"sum(case when v_{n}<>0 then (1-p)*c else 0 end)", 0.3, 0.02, 0.99) + f" b_{n}"
            for n in names
        )
        sql += f",\nm{k + 1} as materialized (select least(0.98, greatest(0.5, sum(p*c)/sum(c))) prior, {cols} from (select pat.*, {post(f'm{k}')} p from pat, m{k}))"
    return sql + f"""
select doc_id, n_words::bigint n_words, word_chars::bigint word_chars, n_symbols::bigint n_symbols, n_dup_lines::bigint n_dup_lines, n_repeat_words::bigint n_repeat_words,
 (n_words<50 or 100*n_repeat_words>50*n_words) base_failed, not (n_words<50 or 100*n_repeat_words>50*n_words) and p>=0.5 kept, round(p, 6) p_good
from (select voted.*, {post(f'm{rounds}')} p from voted, m{rounds})"""
