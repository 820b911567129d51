"""Cross-day matching of candidates to a ledger, and what follows from a match."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import fixed as K
from tidewatch.functions import text as T
from tidewatch.sources.shared import kept


def exact_matches(cands: DataFrame, ledger: DataFrame) -> DataFrame:
    """(cand_id, row_pos): the first ledger row with a candidate's canonical key."""
    first = ledger.groupBy("canonical_key").agg(F.min("pos").alias("row_pos"))
    return cands.select("cand_id", "canonical_key").join(first, "canonical_key").select("cand_id", "row_pos")


#: Rows of one first token, on either side, that meet in one task.
SLICE = 1 << 13
WORDS = ("w0", "w1", "w2", "w3")


def _marked(rows: DataFrame) -> DataFrame:
    """rows with what a pair is first judged by: n tokens, a hash of the first, a set bit for each token in `bits`, and in four more words a bit turned for each."""
    hashes = F.array_distinct(F.transform("toks", lambda t: F.xxhash64(t)))
    one = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    ors = F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: acc.bitwiseOR(one(h)))
    word = lambda i: F.aggregate(F.filter(hashes, lambda h: F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(3)) == i), F.lit(0).cast("long"), lambda acc, h: acc.bitwiseXOR(one(h)))
    return rows.withColumns({"n": F.size(F.array_distinct("toks")), "head": F.xxhash64(F.get("toks", F.lit(0))), "bits": ors} | {w: word(i) for i, w in enumerate(WORDS)})


def _few_apart(apart: Column, n: Column, threshold: float) -> Column:
    """Two sets of n tokens together, of which `apart` or more are in one only, may have a Jaccard similarity of `threshold`."""
    return apart <= n * ((1 - threshold) / (1 + threshold)) + 1e-9


def _only(a: str, b: str) -> Column:
    """Bits of a that b lacks: at least so many tokens of a are not in b."""
    return F.bit_count(F.col(a).bitwiseAND(F.bitwise_not(b)))


def _ordered_tokens(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l, k, n, head, bits, at): of each row of both sides the tokens that the other side has too, as (r, h): hashes and ranks.

    Tokens of one side only come first, they take ranks but make no pairs; the others follow by the number of pairs they make. Equal
    hashes of different tokens make more pairs, never fewer.
    """
    side = lambda df, l, k: df.select(F.lit(l).alias("l"), F.col(k).alias("k"), "n", "head", "bits", "toks")  # noqa: E731, E741
    rows = side(left, True, "lid").unionByName(side(right, False, "rid"))
    each = rows.select("l", "k", F.explode(F.array_distinct("toks")).alias("t")).select("l", "k", F.xxhash64("t").alias("h"))
    freq = each.groupBy("h").agg((F.count_if("l") * F.count_if(~F.col("l"))).alias("f")).filter("f > 0")
    lists = each.join(freq, "h").groupBy("l", "k").agg(F.array_sort(F.collect_list(F.struct("f", "h"))).alias("hs"))
    found = lists.join(rows.drop("toks"), ["l", "k"])
    at = F.transform("hs", lambda x, i: F.struct((F.col("n") - F.size("hs") + i + 1).alias("r"), x["h"].alias("h")))
    return kept(found.select("l", "k", "n", "head", "bits", at.alias("at")), "ordered-tokens")


def _postings(ordered: DataFrame, l: bool, last: Column) -> DataFrame:  # noqa: E741
    """A row for each token of rank up to `last` of one side's rows."""
    k, p = ("lid", "l") if l else ("rid", "r")
    rows = ordered.filter(F.col("l") if l else ~F.col("l"))
    each = rows.select(F.col("k").alias(k), *[F.col(c).alias(f"{p}{c}") for c in ("n", "head", "bits")], F.explode(F.filter("at", lambda x: x["r"] <= last)).alias("x"))
    return each.select("*", "x.h").drop("x")


def _prefix(threshold: float) -> Column:
    """The rank up to which two sets of such a Jaccard similarity share a token."""
    return F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1


def _alike(ordered: DataFrame, threshold: float) -> DataFrame:
    """Pairs that share a token of their prefixes and whose bits allow for the threshold; one may come often."""
    sized = (F.col("ln") >= threshold * F.col("rn") - 1e-9) & (F.col("rn") >= threshold * F.col("ln") - 1e-9)
    pairs = _postings(ordered, True, _prefix(threshold)).join(_postings(ordered, False, _prefix(threshold)), "h")
    return pairs.filter(sized & _few_apart(_only("lbits", "rbits") + _only("rbits", "lbits"), F.col("ln") + F.col("rn"), threshold))


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(lid, rid) of all pairs whose token sets have a Jaccard similarity of `threshold` or more, and perhaps others.

    Prefix filtering: with tokens in one order, here of rising frequency, two such sets share one of the first
    n - ceil(threshold * n) + 1. Equal sets meet pair by pair, so rows that are alike should come as one.
    """
    return _alike(_ordered_tokens(_marked(left), _marked(right)), threshold).select("lid", "rid").distinct()


def _near_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs with SimHashes within DUP_HAMMING bits, the ledger's not 0, and bits of one within the other's: of DUP_HAMMING + 3 blocks of bits they share three."""
    blocks = K.DUP_HAMMING + 3
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum((1 << hi) - (1 << lo) for lo, hi in (edges[i : i + 2] for i in some)) for some in combinations(range(blocks), 3)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = F.posexplode(F.array(*[F.col("simhash").bitwiseAND(F.lit(signed(m)).cast("long")) for m in masks])).alias("i", "e")
    side = lambda df, k, p: df.select(k, F.col("simhash").alias(f"{p}h"), *[F.col(c).alias(f"{p}{c}") for c in ("head", "bits")], keys)
    within = (_only("lbits", "rbits") == 0) | (_only("rbits", "lbits") == 0)
    return side(left, "lid", "l").join(side(right.filter("simhash <> 0"), "rid", "r"), ["i", "e"]).filter((T.hamming(F.col("lh"), F.col("rh")) <= K.DUP_HAMMING) & within)


def _soft_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(lid, rid) of all pairs of different first tokens that may match, and perhaps others.

    With a Jaccard of DUP_JACCARD: prefix filtering. With subjects that agree: one within the other. So the rarest token of the
    one is in the other, and with a Jaccard of SOFT_JACCARD in its prefix; with near SimHashes: blocks of bits.
    """
    left, right = _marked(left.select("lid", "toks", "simhash")), _marked(right.select("rid", "toks", "simhash"))
    ordered = _ordered_tokens(left, right)
    rarest, low = F.lit(1), _prefix(K.SOFT_JACCARD)
    within = _postings(ordered, True, rarest).join(_postings(ordered, False, low), "h").filter((F.col("ln") <= F.col("rn")) & (F.col("ln") >= K.SOFT_JACCARD * F.col("rn") - 1e-9) & (_only("lbits", "rbits") == 0))
    around = _postings(ordered, True, low).join(_postings(ordered, False, rarest), "h").filter((F.col("rn") <= F.col("ln")) & (F.col("rn") >= K.SOFT_JACCARD * F.col("ln") - 1e-9) & (_only("rbits", "lbits") == 0))
    found = [df.filter("lhead <> rhead").select("lid", "rid") for df in (_alike(ordered, K.DUP_JACCARD), within, around, _near_pairs(left, right))]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3]).distinct()


FACTS = ("ents", "track", "toks", "simhash")


def _classes(rows: DataFrame) -> DataFrame:
    """rows with column `cls`: a name for what they are compared by, so that rows which are alike share it."""
    return rows.withColumn("cls", F.sha1(F.to_json(F.struct(*FACTS), {"ignoreNullFields": "false"})))


def _best(full: DataFrame) -> DataFrame:
    """(lid, b): the best (sim, pos) of each candidate that has a match among these pairs; full has n and the facts of both sides, as l_ and r_.

    A pair's similarity is made once; pairs that don't match are null, which no maximum takes.
    """
    both = F.size(F.array_intersect("l_toks", "r_toks"))
    shared = F.size(F.array_intersect("l_ents", "r_ents"))
    strong = (shared >= 2) | ((shared >= 1) & (F.col("l_track") == F.col("r_track")))
    near = (F.col("r_simhash") != 0) & (T.hamming(F.col("l_simhash"), F.col("r_simhash")) <= K.DUP_HAMMING)
    subject = (F.get("l_toks", F.lit(0)) == F.get("r_toks", F.lit(0))) | T.subjects_agree(F.col("l_toks"), F.col("r_toks"))
    rule = lambda sim: F.when((sim >= K.DUP_JACCARD) | (((sim >= K.SOFT_JACCARD) | near) & strong & subject), F.struct(sim.alias("sim"), "pos"))
    hit = T.once(both, lambda o: rule(F.when(o > 0, o / (F.col("l_n") + F.col("r_n") - o)).otherwise(0.0)))
    return full.select("lid", hit.alias("b")).groupBy("lid").agg(F.max("b").alias("b")).filter("b IS NOT NULL")


def _facts(p: str) -> list[Column]:
    return [F.col(c).alias(f"{p}_{c}") for c in ("n", *FACTS)]


def _led_best(left: DataFrame, right: DataFrame) -> DataFrame:
    """The best of each candidate among the rows of its first token.

    Each row is sent once, with all that is compared, and pairs are judged where they meet: first by bits and SimHashes. Rows of a
    frequent first token are sent to a grid of slices, once a slice of the other side.
    """
    heads = left.select("head", F.lit(True).alias("l")).unionByName(right.select("head", F.lit(False).alias("l")))
    slices = lambda c: F.ceil(F.count_if(c) / SLICE).cast("int")
    many = F.broadcast(kept(heads.groupBy("head").agg(slices(F.col("l")).alias("a"), slices(~F.col("l")).alias("b")).filter("a > 1 OR b > 1"), "frequent-heads"))
    own = lambda k, s: F.pmod(F.xxhash64(k), F.coalesce(F.greatest(s, F.lit(1)), F.lit(1))).cast("int")
    every = lambda s: F.explode(F.sequence(F.lit(0), F.coalesce(F.greatest(s, F.lit(1)), F.lit(1)) - 1))
    words = lambda p: [F.col(w).alias(f"{p}_{w}") for w in WORDS]
    x = left.join(many, "head", "left").select("head", own("lid", "a").alias("i"), every("b").alias("j"), "lid", *_facts("l"), *words("l"))
    y = right.join(many, "head", "left").select("head", every("a").alias("i"), own("rid", "b").alias("j"), "pos", *_facts("r"), *words("r"))
    apart = sum((T.hamming(F.col(f"l_{w}"), F.col(f"r_{w}")) for w in WORDS), F.lit(0))
    maybe = _few_apart(apart, F.col("l_n") + F.col("r_n"), K.SOFT_JACCARD) | (T.hamming(F.col("l_simhash"), F.col("r_simhash")) <= K.DUP_HAMMING)
    return _best(x.join(y, ["head", "i", "j"]).filter(maybe))


def soft_matches(cands: DataFrame, ledger: DataFrame) -> DataFrame:
    """(cand_id, row_pos, similarity): the best ledger row by token Jaccard, the last of equals.

    Both sides have columns ents (key entities), track, toks (at most 64 tokens) and simhash. A row matches
    with a Jaccard of DUP_JACCARD; or, if keys agree strongly and subjects agree, with near SimHashes or a Jaccard of
    SOFT_JACCARD. Subjects agree mostly by the first token: such pairs are judged where they meet (`_led_best`), and of a row's matches a
    task sends the best. The others meet on what the texts' similarity demands (`_soft_pairs`), rare tokens and bits of SimHashes; few are
    left to be compared. A frequent pair of entities makes no pairs.
    Rows of a side that are alike in all of these are one class, compared once: of ledger rows alike the last is the only one
    wanted, and candidates alike have the same answer. So n copies against m make one pair.
    """
    mine = _classes(cands).select("cand_id", "cls", *FACTS)
    left = kept(mine.groupBy("cls").agg(F.min("cand_id").alias("lid"), *[F.any_value(c).alias(c) for c in FACTS]), "candidate-classes")
    right = kept(_classes(ledger.filter(F.col("text") != "")).groupBy("cls").agg(F.max("pos").alias("pos"), *[F.any_value(c).alias(c) for c in FACTS]).drop("cls").withColumn("rid", F.col("pos")), "ledger-classes")
    pairs = kept(_soft_pairs(left, right), "ledger-pairs")
    left, right = _marked(left), _marked(right)
    met = pairs.join(left.select("lid", *_facts("l")), "lid").join(right.select("rid", "pos", *_facts("r")), "rid")
    best = _led_best(left, right).unionByName(_best(met)).groupBy("lid").agg(F.max("b").alias("b"))
    best = kept(left.select("lid", "cls").join(best, "lid").select("cls", "b"), "best-rows")
    return mine.select("cand_id", "cls").join(best, "cls").select("cand_id", F.col("b.pos").alias("row_pos"), F.col("b.sim").alias("similarity"))


def matches(cands: DataFrame, ledger: DataFrame) -> DataFrame:
    """(cand_id, row_pos, how): exact matches first, soft ones for the rest. Each side is made once, and the answer is a table that may be read often."""
    cands, ledger = kept(cands, "candidates"), kept(ledger, "ledger")
    exact = kept(exact_matches(cands, ledger), "exact-matches")
    rest = cands.join(exact, "cand_id", "left_anti")
    soft = soft_matches(rest, ledger).select("cand_id", "row_pos", F.lit("soft").alias("how"))
    return exact.withColumn("how", F.lit("exact")).unionByName(soft)


def branch(matched: Column, stage: Column, prev_stage: Column, score: Column, prev_score: Column, sources: Column, prev_sources: Column) -> Column:
    """NEW without a match; RESURFACE on a new stage, a score jump or a new source that makes two; else SUPPRESS."""
    staged = (F.coalesce(stage, F.lit("")) != "") & (stage != F.coalesce(prev_stage, F.lit("")))
    jumped = F.abs(F.coalesce(score, F.lit(0.0)) - F.coalesce(prev_score, F.lit(0.0))) >= K.RESURFACE_JUMP
    grown = (F.size(F.array_except(sources, prev_sources)) > 0) & (F.size(prev_sources) < 2) & (F.size(sources) >= 2)
    return F.when(~matched, "NEW").when(staged | jumped | grown, "RESURFACE").otherwise("SUPPRESS")


def fold_samples(old: Column, new: Column, most: int = K.SAMPLES_CAP) -> Column:
    """A ring buffer: the last `most` of the old samples and the new ones."""
    every = F.concat(F.coalesce(old, F.array()), new)
    return F.slice(every, F.greatest(F.size(every) - most + 1, F.lit(1)), most)


def upsert(old: DataFrame, new: DataFrame, key: str = "canonical_key") -> DataFrame:
    """Ledger state after new cards: first_seen kept, last_seen and score of the newest, pushes added up, sources united.

    Both sides aggregate, so the order of their rows doesn't matter; equal times go to the greater score. What is held of a
    key's sources are its different sets, merged in each task before the shuffle, not one for each of its cards.
    """
    every = old.unionByName(new)
    last = F.max(F.struct("last_seen", "last_score", "lifecycle_stage")).alias("__l")
    out = every.groupBy(key).agg(F.min("first_seen").alias("first_seen"), last, F.sum("push_count").alias("push_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("source_set")))).alias("source_set"))
    return out.select(key, "first_seen", "__l.last_seen", "__l.last_score", "__l.lifecycle_stage", "push_count", "source_set")
