"""Lexicon scoring of headlines with built-in array functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions.rolling import clip


def lowered(text: Column) -> Column:
    """Lower case letter by letter, as SQL does it: a dotted capital I becomes one letter, a sigma at the end of a word one like others."""
    return F.lower(F.translate(text, "\u0130\u03a3", "i\u03c3"))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and apostrophes; a missing text has none."""
    return F.regexp_extract_all(lowered(F.coalesce(text, F.lit(""))), F.lit("([a-z']+)"), 1)


def _any(words: Sequence[str], token: Column) -> Column:
    return token.isin(*words) if words else F.lit(False)


def lexicon_score(toks: Column, positive: Sequence[str], negative: Sequence[str], uncertain: Sequence[str], negation: Sequence[str],
                  intensifiers: Sequence[str], tickers: Mapping[str, str]) -> Column:
    """struct(sentiment, uncertainty, tickers) of a token array.

    A negation or intensifier acts on the next token that is neither: a negated gain counts as
    a loss, a negated loss as half a gain, an intensified word 1.5 times. Sums are divided by
    the root of the token count; sentiment stays in [-1, 1]. The walk is one fold over the
    whole text with six numbers of state.
    """
    start = F.struct(*[F.lit(0.0).alias(n) for n in ("pos", "neg", "unc")], F.lit(False).alias("inv"), F.lit(False).alias("amp"))

    def step(s: Column, t: Column) -> Column:
        inv, amp = _any(negation, t), _any(intensifiers, t)
        skip = inv | amp
        mult = F.when(s["amp"], 1.5).otherwise(1.0)
        good = ~skip & _any(positive, t)
        bad = ~skip & ~_any(positive, t) & _any(negative, t)
        zero = F.lit(0.0)
        return F.struct(
            (s["pos"] + F.when(good & ~s["inv"], mult).when(bad & s["inv"], mult * 0.5).otherwise(zero)).alias("pos"),
            (s["neg"] + F.when(good & s["inv"], mult).when(bad & ~s["inv"], mult).otherwise(zero)).alias("neg"),
            (s["unc"] + F.when(~skip & _any(uncertain, t), 1.0).otherwise(zero)).alias("unc"),
            F.when(inv, True).when(amp, s["inv"]).otherwise(False).alias("inv"),
            F.when(inv, s["amp"]).when(amp, True).otherwise(False).alias("amp"))

    def finish(s: Column) -> Column:
        n = F.sqrt(F.greatest(F.size(toks), F.lit(1)).cast("double"))
        return F.struct(clip((s["pos"] - s["neg"]) / n, -1.0, 1.0).alias("sentiment"), (s["unc"] / n).alias("uncertainty"))

    names = F.create_map(*[x for k, v in tickers.items() for x in (F.lit(k), F.lit(v))])
    plain = F.filter(toks, lambda t: ~_any([*negation, *intensifiers], t))
    found = F.array_sort(F.array_distinct(F.array_compact(F.transform(plain, lambda t: names[t]))))
    return F.struct(F.aggregate(toks, start, step, finish).alias("score"), found.alias("tickers"))


def vote_blend(sentiment: Column, up: Column, down: Column) -> Column:
    """60 % text, 40 % crowd votes where there are any."""
    # four tenths of the counts are rounded once, before the division
    return F.when(up + down > 0, 0.6 * sentiment + F.try_divide((up - down) * 4 / 10, up + down)).otherwise(sentiment)


def sentiment_features(index: Column, score: Column, volume: Column, ticker_score: Column) -> dict[str, Column]:
    """Fear-greed index scaled, its extremes, capped news volume, ticker score and its size."""
    t = F.coalesce(ticker_score, score)
    return {"index_norm": index / 100.0, "extreme_fear": F.when(index < 25, 1.0).otherwise(0.0), "extreme_greed": F.when(index > 75, 1.0).otherwise(0.0), "news_score": score,
            "news_volume": F.least(volume / 50.0, F.lit(1.0)), "ticker_score": t, "ticker_magnitude": F.abs(t)}


def title_key(title: Column) -> Column:
    """Titles that agree but for case count as one."""
    return lowered(title)
