"""A reader's view of stored editions: filters, sections as learnt, and slots anew."""

from __future__ import annotations

from pyspark.sql import DataFrame

from newsprint.operators import classify, filters
from newsprint.operators.dedupe import KEYS
from newsprint.plans.publish import place
from newsprint.session import cut


def train(moves: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(token counts, section statistics, pins) from a log of moves; the last moves are written as tokens, so that texts are
    shuffled and tokenised once."""
    last = cut(classify.with_tokens(classify.latest_corrections(moves)))
    return classify.train_token_counts(last), classify.train_section_stats(last), last.select("item_id", "section")


def reflow(
    items: DataFrame, feeds: DataFrame, hosts: DataFrame, read: DataFrame, pins: DataFrame, predicted: DataFrame,
    checks: DataFrame | None = None, keys: tuple[str, ...] = KEYS, tie: tuple[str, ...] = (),
) -> DataFrame:
    """The stored rows are left as they are; what the filters leave is deduped and placed again, so slots refill.

    Keys beside the date, such as reader_id, are those of whoever reads: feeds, hosts, read items, pins and predictions
    have these columns too, and a reader's rows apply to that reader alone.
    """
    by = tuple(k for k in keys if k not in KEYS)
    seen = filters.drop_excluded_hosts(filters.drop_paused(items, feeds, by), hosts, by)
    seen = filters.hide_read(seen, read, (*by, "item_id"))
    return place(filters.resolve_section(seen, pins, predicted, feeds, by), checks, keys, tie)
