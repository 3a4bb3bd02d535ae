"""Contact details that begin on one page and end on the next.

The checks read the pages of a host as one text, with a line break between pages.  What a page can
add to a detail of its neighbours is a few numbers: ``joined`` folds two neighbours' into one, so
pages are folded in ranges first and ranges by host after, and no host's pages meet in a task.
An e-mail address holds no white space and never crosses a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerscope.functions import html as H
from answerscope.functions.core import NOT_AFTER_WORD as NB, NOT_BEFORE_WORD as NA, WS, bind

#: pages of a host that are folded at a time
RANGE = 4096
# fixed values: characters between the digits of a phone number, how far apart its ends are at least, words for streets
FILL = " \t\n\x0b\f\r ().-"
PHONE_RUN, PHONE_SPAN = r"[\d\s\x{a0}().-]", 8
STREET_WORDS = "(?:street|st|avenue|ave|road|rd|boulevard|blvd|lane|ln|drive|dr|suite|ste)"

SEAM = ("struct<phone:boolean,full:boolean,len:bigint,last:bigint,first:bigint,"
        "after0:int,after1:int,after2:int,met0:boolean,met1:boolean,met2:boolean>")


def seam(text: Column) -> Column:
    """What a page adds at its ends.

    Phone: the offset of the last digit of the run the page begins with, how far from the end the
    first digit of the run it ends with, whether the page is one such run.  Street: with nothing
    (0), a number (1) or a number and a word (2) pending before the page, what is pending after it,
    and whether an address was completed.
    """
    def of(t: Column) -> Column:
        head = F.regexp_extract(t, f"^{PHONE_RUN}*+", 0)
        tail = F.regexp_extract(t, rf"(?<!{PHONE_RUN}){PHONE_RUN}*+\z", 0)
        last = F.length(F.rtrim(head, F.lit(FILL)))
        first = F.length(F.ltrim(tail, F.lit(FILL)))
        blank = t.rlike(rf"^{WS}*+\z")
        word = t.rlike(rf"^{WS}*+[A-Za-z]{{2,}}+{WS}*+\z")
        own = F.when(t.rlike(rf"{NB}\d{{1,5}}{WS}*+\z"), 1).when(t.rlike(rf"{NB}\d{{1,5}}{WS}++[A-Za-z]{{2,}}+{WS}*+\z"), 2).otherwise(0)
        ends = lambda pattern: t.rlike(rf"(?i)^{WS}*+{pattern}{NA}")
        return F.struct(
            F.lit(False).alias("phone"), (F.length(head) == F.length(t)).alias("full"), F.length(t).alias("len"),
            F.when(last > 0, last - 1).alias("last"), F.when(first > 0, first).alias("first"),
            F.when(blank, 0).otherwise(own).alias("after0"), F.when(blank, 1).when(word, 2).otherwise(own).alias("after1"), F.when(blank, 2).otherwise(own).alias("after2"),
            F.lit(False).alias("met0"), ends(rf"[a-z]{{2,}}+{WS}++{STREET_WORDS}").alias("met1"), ends(STREET_WORDS).alias("met2")).cast(SEAM)

    return bind(F.coalesce(text, F.lit("")), of)


def joined(a: Column, b: Column) -> Column:
    """Two neighbours as one, a line break between them."""
    def after(s: Column, field: str) -> Column:
        return F.when(s == 0, b[f"{field}0"]).when(s == 1, b[f"{field}1"]).otherwise(b[f"{field}2"])

    return F.struct(
        (a["phone"] | b["phone"] | F.coalesce(a["first"] + 1 + b["last"] >= PHONE_SPAN, F.lit(False))).alias("phone"),
        (a["full"] & b["full"]).alias("full"), (a["len"] + 1 + b["len"]).alias("len"),
        F.when(a["full"], F.coalesce(a["len"] + 1 + b["last"], a["last"])).otherwise(a["last"]).alias("last"),
        F.when(b["full"], F.coalesce(a["first"] + 1 + b["len"], b["first"])).otherwise(b["first"]).alias("first"),
        *[after(a[f"after{s}"], "after").alias(f"after{s}") for s in range(3)],
        *[(a[f"met{s}"] | after(a[f"after{s}"], "met")).alias(f"met{s}") for s in range(3)]).cast(SEAM)


def _folded(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    listed = F.transform(F.array_sort(F.collect_list(F.struct(*order, "seam"))), lambda x: x["seam"])
    gathered = rows.groupBy(*by).agg(listed.alias("seams"))
    return gathered.select(*by, F.aggregate(F.slice("seams", F.lit(2), F.size("seams")), F.get("seams", F.lit(0)), joined).alias("seam"))


def across_pages(pages: DataFrame) -> DataFrame:
    """host, phone, street: whether one stands across the pages of a host, taken in order of ``page_ord``, then URL."""
    rows = pages.select("host", F.floor(F.col("page_ord") / RANGE).alias("range"), "page_ord", "url", seam(H.to_text("html")).alias("seam"))
    ranges = _folded(rows, ["host", "range"], ["page_ord", "url"])
    return _folded(ranges, ["host"], ["range"]).select("host", F.col("seam.phone").alias("phone"), F.col("seam.met0").alias("street"))
