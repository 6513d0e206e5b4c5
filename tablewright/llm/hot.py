"""Joining facts to rows whose keys may be hot."""

from pyspark.sql import functions as F

SHARE = 1000  # a key with more than one row in so many is hot; there are fewer hot keys than this


def attach(rows, facts, key, size, total):
    """``rows`` with the other columns of ``facts``, which has one line for each key of ``rows``.

    ``size`` names the column of ``facts`` with the number of rows of a key,
    ``total`` is the number of all rows.  Fewer than ``SHARE`` keys are hot; their
    facts go to every task, so their rows stay where they are.  The other rows
    meet their facts in a shuffle, where no key has more than a thousandth.
    """
    hot = facts.where(F.col(size) * SHARE > total).drop(size)
    here = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(facts.drop(size), key)
    return here.unionByName(rest)
