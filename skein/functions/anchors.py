"""Where to look for a snippet in the text that it came from: runs of its words, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.text import collapse, tokens

# Words of an anchor, its characters and how many there are.
SIZES, LONGEST, SHORTEST, MOST = (18, 12, 8, 5), 180, 12, 12


def anchors(snippet: Column, highlight: Column) -> Column:
    """Runs of words to search for, longest first: of each stretch between ellipses that holds the highlight, those that hold it.

    A run of n words takes the highlighted word at its middle, at its end or at its beginning. Without any such stretch the
    longest one is taken, about its middle. Runs that are too short to tell, and repeated ones, are left out; long ones end
    at a word within the limit.
    """
    mark = F.array_join(tokens(highlight), " ")
    holds = lambda text: (mark != "") & F.contains(F.array_join(tokens(text), " "), mark)
    stretches = F.filter(F.transform(F.split(snippet, r"…|\.\.\."), collapse), lambda s: F.size(F.split(s, " ")) >= 3)
    marked = F.filter(stretches, holds)
    longest = F.slice(F.transform(F.array_sort(F.transform(stretches, lambda s: F.struct((-F.length(s)).alias("n"), s.alias("s")))), lambda x: x["s"]), 1, 1)
    chosen = F.when(F.size(marked) > 0, marked).otherwise(longest)

    def runs(stretch: Column) -> Column:
        words = F.split(stretch, " ")
        hits = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: holds(F.element_at(words, i)))
        at = F.coalesce(F.try_element_at(hits, F.lit(1)), F.floor(F.size(words) / 2).cast("int") + 1)

        def of(size: Column) -> Column:
            n = F.least(size, F.size(words))
            first = lambda ahead: F.greatest(F.lit(1), F.least(at - ahead, F.size(words) - n + 1)).cast("int")
            return F.transform(F.array(first(F.floor(n / 2)), first(n - 1), first(F.lit(0))), lambda k: F.array_join(F.slice(words, k, n), " "))

        return F.flatten(F.transform(F.array(*map(F.lit, SIZES)), of))

    # a word that would go over the limit ends the run
    bounded = lambda s: F.when(F.length(s) <= LONGEST, s).otherwise(F.regexp_extract(s, rf"^(.{{0,{LONGEST}}})(?: |$)", 1))
    found = F.transform(F.flatten(F.transform(chosen, runs)), bounded)
    return F.slice(F.array_distinct(F.filter(found, lambda s: F.length(s) >= SHORTEST)), 1, MOST)
