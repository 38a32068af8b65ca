"""Token sequences: padding, masks, training rows, and the way between padded and ragged arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators.batch import positions


def _arr(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def truncate(c: Column | str, length: int, how: str = "right") -> Column:
    """At most ``length`` elements. how: which side (left, right) or the middle is cut, or error to raise."""
    c = _arr(c)
    n, half = F.size(c), length // 2
    if how == "right":
        return F.slice(c, 1, length)
    if how == "left":
        return F.when(n > length, F.slice(c, n - length + 1, length)).otherwise(c)
    if how == "middle":
        return F.when(n > length, F.concat(F.slice(c, 1, half), F.slice(c, n - (length - half) + 1, length - half))).otherwise(c)
    if how == "error":
        return F.when(n > length, F.raise_error(F.lit(f"longer than {length}")).cast("array<int>")).otherwise(c)
    raise ValueError(f"no truncation has the name {how}")


def pad(c: Column | str, length: int, value: int = 0, left: bool = False) -> Column:
    c = _arr(c)
    more = F.array_repeat(F.lit(value), F.greatest(F.lit(length) - F.size(c), F.lit(0)))
    return F.concat(more, c) if left else F.concat(c, more)


def pad_or_truncate(c: Column | str, length: int, value: int = 0, left: bool = False, how: str = "right") -> Column:
    return pad(truncate(c, length, how), length, value, left)


def ones(n: Column, total: int, left: bool = False) -> Column:
    """A mask of n ones, padded with zeros to total."""
    return pad(F.array_repeat(F.lit(1), n), total, 0, left)


def unpad_left(c: Column | str, mask: Column | str) -> Column:
    c, m = _arr(c), F.aggregate(_arr(mask), F.lit(0), lambda a, x: a + x)
    return F.slice(c, F.size(c) - m + 1, m)


def words(c: Column | str) -> Column:
    """Lower-case runs of ASCII letters and digits: the plain tokenizer."""
    return F.regexp_extract_all(F.lower(_arr(c)), F.lit("[a-z0-9]+"), F.lit(0))


def vocabulary(df: DataFrame, tokens: str) -> DataFrame:
    """(token, id): tokens numbered in their order. Different tokens alone are numbered, range by range."""
    return positions(df.select(F.explode(tokens).alias("token")).distinct(), "token", pos="id")


def not_too_long(tokens: str, most: int) -> Column:
    return F.coalesce(F.size(tokens) <= most, F.lit(False))


def until_stop(c: Column | str, stops: list[int]) -> Column:
    """A mask of ones up to and with the first stop token."""
    c = _arr(c)
    is_stop = F.transform(c, lambda x: x.isin(*stops))
    first = F.array_position(is_stop, True)
    return F.transform(c, lambda x, i: F.when((first == 0) | (i < first), 1).otherwise(0))


def sft_row(prompt: Column | str, response: Column | str, eos: int, length: int) -> Column:
    """struct(input_ids, attention_mask, position_ids, loss_mask). The loss covers what predicts the response: from the prompt's
    last token to the one before the end."""
    p = _arr(prompt)
    ids = F.concat(p, _arr(response), F.array(F.lit(eos)))
    n = F.least(F.size(ids), F.lit(length))
    places = F.sequence(F.lit(0), F.lit(length - 1))
    loss = F.transform(places, lambda i: F.when((i >= F.size(p) - 1) & (i < n - 1), 1).otherwise(0))
    position = F.transform(places, lambda i: F.least(i, n - 1))
    return F.struct(pad_or_truncate(ids, length).alias("input_ids"), ones(n, length).alias("attention_mask"), position.alias("position_ids"), loss.alias("loss_mask"))


def preference_pair(prompt: Column | str, chosen: Column | str, rejected: Column | str, eos: int, length: int) -> Column:
    """array(chosen, rejected): each the prompt, the answer and the end, padded with 0 or cut on the right."""
    own = lambda r: pad_or_truncate(F.concat(_arr(prompt), _arr(r), F.array(F.lit(eos))), length)
    return F.array(own(chosen), own(rejected))


def rollout_row(prompt: Column | str, response: Column | str, stops: list[int], max_prompt: int, max_response: int, pad_id: int = 0) -> Column:
    """struct(input_ids, attention_mask, position_ids, response_mask): the prompt padded on the left, the response on the right."""
    p, r = truncate(prompt, max_prompt, "left"), truncate(response, max_response)
    alive = pad(until_stop(r, stops), max_response, 0)
    mask = F.concat(ones(F.size(p), max_prompt, left=True), alive)
    # the mask is zeros, then ones, then zeros, so a place's running sum is its distance from the ones' first, up to their number
    ones_, before = F.aggregate(mask, F.lit(0), lambda a, x: a + x), F.lit(max_prompt) - F.size(p)
    upto = F.transform(F.sequence(F.lit(0), F.lit(max_prompt + max_response - 1)), lambda i: F.greatest(F.least(i - before, ones_ - 1), F.lit(0)))
    return F.struct(F.concat(pad(p, max_prompt, pad_id, True), pad(r, max_response, pad_id)).alias("input_ids"), mask.alias("attention_mask"), upto.alias("position_ids"), alive.alias("response_mask"))


def ragged(c: Column | str, mask: Column | str, response_length: Column | str) -> Column:
    """struct(input_ids, position_ids, loss_mask) without padding; the loss covers the response (nothing if it is empty)."""
    ids = F.transform(F.filter(F.arrays_zip(_arr(c).alias("a"), _arr(mask).alias("m")), lambda x: x["m"] == 1), lambda x: x["a"])
    n, r = F.size(ids), _arr(response_length)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.struct(ids.alias("input_ids"), places.alias("position_ids"), F.transform(places, lambda i: F.when(i >= n - r, 1).otherwise(0)).alias("loss_mask"))


def padded(values: Column | str, response_length: Column | str, most: int) -> Column:
    """The values of the response's window, which begins one place before it, padded with 0 on the right."""
    v, r = _arr(values), _arr(response_length)
    return pad(F.slice(v, F.size(v) - r, r), most)


def turn_masks(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", length: str = "n_tokens", opening: int = 2) -> DataFrame:
    """df with the first and last-plus-one place of the turn's tokens, and loss_tokens: those of an assistant's turn behind its opening."""
    order = W.partitionBy(conversation).orderBy(turn)
    end = F.sum(length).over(order.rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("end", end).withColumn("start", F.col("end") - F.col(length)).withColumn("loss_tokens", F.when(F.col("role") == "assistant", F.greatest(F.col(length) - opening, F.lit(0))).otherwise(0))


def role_order_ok(df: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conversation, ok): an optional system turn first, then user and assistant by turns. ok is false otherwise."""
    order = W.partitionBy(conversation).orderBy(turn)
    rows = df.withColumns({"__n": F.row_number().over(order), "__last": F.lag("role").over(order)})
    role, last = F.col("role"), F.col("__last")
    good = F.when(role == "system", F.col("__n") == 1).when(role == "user", last.isNull() | last.isin("system", "assistant")).when(role == "assistant", last == "user").otherwise(F.lit(False))
    return rows.groupBy(conversation).agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("ok"))


def place_reward(df: DataFrame, reward: str, length: str, pos: str = "pos") -> DataFrame:
    """Token rewards: the response's reward at its last valid token, else 0."""
    return df.withColumn("token_reward", F.when(F.col(pos) == F.col(length) - 1, F.col(reward)).otherwise(0.0))


def same_tokens(whole: Column | str, pieces: Column | str) -> Column:
    """Whether one encoding of the whole is that of its pieces joined (array<array>)."""
    return _arr(whole).eqNullSafe(F.flatten(_arr(pieces)))


def response_mask(attention: Column | str, response_length: Column | str) -> Column:
    """The mask's last places."""
    a, n = _arr(attention), _arr(response_length)
    return F.slice(a, F.size(a) - n + 1, n)


def total(mask: Column | str) -> Column:
    return F.aggregate(_arr(mask), F.lit(0), lambda a, x: a + x)


def near_whole(c: Column | str, tolerance: float = 1e-6) -> Column:
    """The whole number that a value nearly is; others raise."""
    c = _arr(c)
    return F.when(F.abs(c - F.round(c)) <= tolerance, F.round(c).cast("long")).otherwise(F.raise_error(F.lit("no whole number")).cast("long"))
