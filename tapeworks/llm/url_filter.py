"""URL filter: address rules first, then naive Bayes on segmented host words and path tokens.

Host names run words together. They are split by a unigram Viterbi search: the word counts come from the text of all
pages (tags left out), a word that no page holds has the probability ``10 / (N * 10^length)``. Only the substrings of
distinct host pieces are looked up, by a join with the full counts, so neither table has to fit anywhere and a host
that a third of the pages share is segmented once.

A multinomial naive Bayes model (add-one smoothing) learns from the pages that a rule decides: how often a token,
``h:`` for words of the host and ``p:`` for parts of the path, is seen in allowed and in blocked pages. Digits count by
their number only. Hosts and paths are scored once per distinct value and joined back to the pages; the tables of
scores are written first, so that Spark broadcasts those whose measured size is small and shuffles the others.
Probabilities are whole millionths of a natural logarithm: sums do not depend on the order of rows.

Defined results: a null url or one without ``://`` has an empty host and path and no token, so the classes' frequency
decides; equal odds allow, as does a model that saw no ruled page. Repeated rows and page ids get a row each, null
ids too. A run of more than ``LONGEST_PIECE`` letters, which no host name may have, is segmented in parts of
that length. An empty table gives no row. Only the named columns are read.

The copies in the shared folder are read by the returned frame; they stay until that folder's owner clears it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.shared import LOWER, UPPER, WHITE, stash

# Fixed values of the contract: a host with its subdomains and the start of a path.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

LONGEST_WORD = 24
LONGEST_PIECE = 256
UNIT = 1e6
TENTH = 2302585  # UNIT * ln 10
ONE_WORD = r"^[^\p{L}]*(\p{L}+)[^\p{L}]*$"
LETTERS = r"\p{L}{1,%d}" % LONGEST_PIECE


def folded(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def address(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    after = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    return (folded(F.regexp_extract(after, "^[^/?#]*", 0)),
            F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; both null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # later ones, the longer, come first
        own, _, start = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + start)
        text, verdict = F.when(fits, F.lit(rule)).otherwise(text), F.when(fits, F.lit(says)).otherwise(verdict)
    return text, verdict


def word_counts(texts: DataFrame, text_col: str) -> DataFrame:
    """(word, n): the words of all texts that are one run of letters between white space, punctuation around it
    aside, ASCII lower-cased, markup tags left out. Addresses in a text are no words of it."""
    plain = folded(F.regexp_replace(F.col(text_col), "<[^<>]*>", " "))
    token = F.explode(F.split(plain, f"[{WHITE}]+")).alias("token")
    words = texts.select(token).select(F.regexp_extract("token", ONE_WORD, 1).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def best_split(piece: Column, known: Column, unknown: int) -> Column:
    """The likeliest words of a piece, in order; of equal ones the longest last word.

    ``known`` maps words to their score. Position by position, the best score of a prefix is that of a shorter one
    plus its last word; the start of that word is kept and followed back from the end.
    """
    def score(k: Column, end: Column) -> Column:
        return F.coalesce(F.try_element_at(known, F.substring(piece, k + 1, end - k)), F.lit(unknown) - TENTH * (end - k))

    def step(seen: Column, end: Column) -> Column:
        hit = F.array_max(F.transform(F.sequence(F.greatest(end - LONGEST_WORD, F.lit(0)), end - 1), lambda k: F.struct(
            (F.get(seen["best"], k) + score(k, end)).alias("score"), (-k).alias("back"))))
        return F.transform(F.array(hit), lambda h: F.struct(
            F.array_append(seen["best"], h["score"]).alias("best"), F.array_append(seen["back"], -h["back"]).alias("back")))[0]

    ends = F.sequence(F.lit(1), F.length(piece))
    back = F.aggregate(ends, F.struct(F.array(F.lit(0).cast("long")).alias("best"), F.array(F.lit(0)).alias("back")), step)["back"]
    return F.transform(F.array(back), lambda b: _followed(piece, ends, b))[0]


def _followed(piece: Column, ends: Column, back: Column) -> Column:
    """The words that end where ``back`` leads, from the end of the piece to its start."""
    def follow(at: Column, _: Column) -> Column:
        start = F.get(back, at["end"])
        return F.when(at["end"] > 0, F.struct(start.alias("end"), F.array_prepend(
            at["words"], F.substring(piece, start + 1, at["end"] - start)).alias("words"))).otherwise(at)

    return F.aggregate(ends, F.struct(F.length(piece).alias("end"), F.array().cast("array<string>").alias("words")), follow)["words"]


def segment(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, words) for distinct hosts: the words of all letter runs in order, ``#`` and the length for digit runs."""
    counts, _ = stash(counts)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(1))).first()[0]
    score = lambda n: F.floor(F.lit(UNIT) * F.log(n / F.lit(float(total)))).cast("long")
    unknown = hosts.sparkSession.range(1).select(score(F.lit(10.0))).first()[0]
    parts = hosts.select("host", F.posexplode(F.regexp_extract_all("host", F.lit(LETTERS + "|[0-9]+"), 0)).alias("nth", "piece"))
    letters = ~F.col("piece").rlike("^[0-9]")
    pieces = parts.where(letters).select("piece").distinct()
    spans = pieces.select("piece", F.explode(F.sequence(F.lit(1), F.length("piece"))).alias("start")).select(
        "piece", "start", F.explode(F.sequence(F.lit(1), F.least(
            F.lit(LONGEST_WORD), F.length("piece") - F.col("start") + 1))).alias("size")).select(
        "piece", F.expr("substring(piece, start, size)").alias("word")).distinct()
    known = spans.join(counts, "word").groupBy("piece").agg(F.map_from_entries(F.collect_list(
        F.struct("word", score(F.col("n")).alias("score")))).alias("known"))  # bounded by one piece's length
    split, _ = stash(pieces.join(known, "piece", "left").select(
        "piece", best_split(F.col("piece"), F.col("known"), unknown).alias("words")))
    shape = F.array(F.concat(F.lit("#"), F.length("piece")))
    named = parts.join(split, "piece", "left").select(
        "host", F.struct("nth", F.when(letters, F.col("words")).otherwise(shape).alias("words")).alias("at"))
    words = named.groupBy("host").agg(F.array_sort(F.collect_list("at")).alias("all")).select(
        "host", F.flatten(F.col("all.words")).alias("words"))
    return hosts.join(words, "host", "left").select("host", F.coalesce("words", F.array().cast("array<string>")).alias("words"))


def path_tokens(path: Column) -> Column:
    """Letter and digit runs of a path; digits by their number."""
    return F.transform(F.regexp_extract_all(folded(path), F.lit(r"\p{L}+|[0-9]+"), 0),
                       lambda t: F.when(t.rlike("^[0-9]"), F.concat(F.lit("#"), F.length(t))).otherwise(t))


def _tokens(kind: str, words: Column) -> Column:
    return F.explode(F.transform(words, lambda w: F.concat(F.lit(kind), w)))


def learn(ruled: DataFrame, host_words: DataFrame) -> tuple[DataFrame, int, int]:
    """(token, weight) of the model, the weight of an unseen token and that of no token at all.

    ``ruled``: host, tokens (of the path), says. Weights above zero speak for ``block``. Pages are combined by host
    and by path tokens before any token is counted.
    """
    blocked = F.col("says") == "block"
    two = [F.sum(blocked.cast("long")).alias("b"), F.sum((~blocked).cast("long")).alias("a")]
    by_host = ruled.groupBy("host").agg(*two).join(host_words, "host").select(_tokens("h:", F.col("words")).alias("token"), "b", "a")
    by_path = ruled.groupBy("tokens").agg(*two).select(_tokens("p:", F.col("tokens")).alias("token"), "b", "a")
    seen, _ = stash(by_host.unionByName(by_path).groupBy("token").agg(F.sum("b").alias("b"), F.sum("a").alias("a")))
    sums = seen.agg(F.count(F.lit(1)), F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("a"), F.lit(0))).first()
    pages = ruled.agg(*[F.coalesce(c, F.lit(0)) for c in two]).first()
    size = sums[0] + 1
    odds = lambda b, a, all_b, all_a: F.floor(F.lit(UNIT) * (
        F.log((b + 1) / F.lit(float(all_b))) - F.log((a + 1) / F.lit(float(all_a))))).cast("long")
    zero = F.lit(0)
    unseen, prior = ruled.sparkSession.range(1).select(
        odds(zero, zero, sums[1] + size, sums[2] + size), odds(F.lit(pages[0]), F.lit(pages[1]), 1, 1)).first()
    return seen.select("token", odds(F.col("b"), F.col("a"), sums[1] + size, sums[2] + size).alias("weight")), unseen, prior


def _scored(table: DataFrame, key: str, kind: str, words: str, weights: DataFrame, unseen: int, name: str) -> DataFrame:
    """(key, summed weight of its tokens) per distinct key, written."""
    one = table.select(key, _tokens(kind, F.col(words)).alias("token")).join(weights, "token", "left")
    return stash(one.groupBy(key).agg(F.sum(F.coalesce("weight", F.lit(unseen))).alias(name)))[0]


def judge(pages: DataFrame, texts: DataFrame | None = None, rules=RULES, id_col: str = "page_id",
          url_col: str = "url", text_col: str = "html") -> DataFrame:
    """(id, host, path, rule, verdict, score, words) per page; ``score`` and ``words`` are the method's, also where
    a rule decides. Word counts come from ``texts`` (``pages`` by default)."""
    host, path = address(F.col(url_col))
    base = pages.select(F.col(id_col).alias("id_"), host.alias("host"), path.alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "says": says, "tokens": path_tokens(F.col("path"))})
    host_words, _ = stash(segment(base.select("host").distinct(), word_counts(pages if texts is None else texts, text_col)))
    weights, unseen, prior = learn(base.where("says is not null"), host_words)
    hosts = _scored(host_words, "host", "h:", "words", weights, unseen, "host_score")
    paths = _scored(base.select("tokens").distinct(), "tokens", "p:", "tokens", weights, unseen, "path_score")
    named, _ = stash(host_words.join(hosts, "host", "left").select(
        "host", F.coalesce("host_score", F.lit(0)).alias("host_score"), F.array_join("words", " ").alias("words")))
    score = F.col("host_score") + F.coalesce("path_score", F.lit(0)) + F.lit(prior)
    return base.join(named, "host").join(paths, "tokens", "left").select(
        F.col("id_").alias(id_col), "host", "path", "rule",
        F.coalesce("says", F.when(score > 0, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        score.cast("long").alias("score"), "words")
