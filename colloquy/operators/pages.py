"""Recognised text of chat screens: labels, sides, columns, bubbles, and pages joined by overlap.

A line is (page, line, text, x0, y0, x1, y1, confidence, width, height).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trim
from ..sources.exports import hour24
from .intervals import with_upper_median

TIME_LABEL = r"\A(?:(오전|오후)\s*)?([01]?\d|2[0-3]):([0-5]\d)\z"
DATE_LABEL = r"\A(\d{4})년\s*(\d{1,2})월\s*(\d{1,2})일(\s*[월화수목금토일]요일)?\s*[>›»〉]?\z"
#: Gap of lines in a bubble as a share of the line's height, and how far left edges may differ.
LINE_GAP, ALIGN = 0.35, 12
SAME_PLACE = 12
MOST_OVERLAP, LEAST_OVERLAP = 15, 2


def time_label(text: Column) -> Column:
    """HH:mm of a time label, null for any other text."""
    t = trim(text)
    hour = hour24(F.regexp_extract(t, TIME_LABEL, 1), F.regexp_extract(t, TIME_LABEL, 2).try_cast("int"))
    return F.when(t.rlike(TIME_LABEL), F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.regexp_extract(t, TIME_LABEL, 3)))


def date_label(text: Column) -> Column:
    """YYYY-MM-DD of a date divider, null for any other text."""
    t = trim(text)
    part = lambda i: F.lpad(F.regexp_extract(t, DATE_LABEL, i), 2, "0")
    return F.when(t.rlike(DATE_LABEL), F.concat_ws("-", F.regexp_extract(t, DATE_LABEL, 1), part(2), part(3)))


def side(lines: DataFrame) -> DataFrame:
    """Whose a line is: the side whose edge is nearer."""
    return lines.withColumn("who", F.when(F.col("width") - F.col("x1") < F.col("x0"), "me").otherwise("other"))


def densest(points: DataFrame, by: list[str]) -> DataFrame:
    """(by, lines, column) out of edges (by, x, tol): of each group the most edges within reach of one, and their upper median; the right one on ties."""
    group = Window.partitionBy(*by)
    edges = points.groupBy(*by, "x", "tol").agg(F.count("*").alias("k"))
    upto_x = F.sum("k").over(group.orderBy("x").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    edges = edges.withColumn("upto", upto_x).withColumn("below", F.col("upto") - F.sum("k").over(Window.partitionBy(*by, "x")))
    # A sweep over edges and the ends of their reach counts the edges within reach of each.
    kinds = F.array(F.struct(F.col("x").alias("at"), F.lit(0).alias("end")), F.struct((F.col("x") + F.col("tol")).alias("at"), F.lit(1).alias("end")))
    swept = edges.select(*by, "x", "below", "upto", "k", F.inline(kinds))
    seen = F.sum(F.when(F.col("end") == 0, F.col("k")).otherwise(0)).over(group.orderBy("at", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = swept.withColumn("n", F.when(F.col("end") == 1, seen - F.col("below")))
    best = counted.withColumn("best", F.max(F.when(F.col("end") == 1, F.struct("n", "x", "below"))).over(group))
    place = F.col("best.below") + F.floor(F.col("best.n") / 2)
    middle = F.when((F.col("below") <= place) & (place < F.col("upto")), F.col("x"))
    return best.groupBy(*by).agg(F.max("best.n").cast("int").alias("lines"), F.max(middle).alias("column"))


def reach() -> Column:
    return F.greatest(F.lit(20.0), 0.05 * F.col("width"))


def column_of(lines: DataFrame, edge: str = "x0") -> DataFrame:
    """The densest column of left edges of each page: its upper median; the right one on ties."""
    return densest(lines.select("page", F.col(edge).alias("x"), reach().alias("tol")), ["page"])


def with_dates(lines: DataFrame) -> DataFrame:
    """Each line with the date of the last divider above it."""
    order = Window.partitionBy("page").orderBy("y0", "x0", "line")
    return lines.withColumn("date", F.last(date_label(F.col("text")), ignorenulls=True).over(order))


#: A box around lines that were joined; ``n`` counts them.
BOX = "struct<line:bigint,text:string,x0:double,y0:double,x1:double,y1:double,confidence:double,n:bigint>"


def boxes_of(lines: Column, fits: Callable[[Column, Column], Column], glue: Callable[[Column, Column], Column]) -> Column:
    """Fold an array of boxes: one that fits the box so far is joined to it, any other begins a new one."""
    joined = lambda a, b: F.struct(a["line"].alias("line"), glue(a["text"], b["text"]).alias("text"), F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["y0"], b["y0"]).alias("y0"), F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1"), F.least(a["confidence"], b["confidence"]).alias("confidence"), (a["n"] + b["n"]).alias("n"))

    def step(done: Column, box: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joins = (F.size(done) > 0) & fits(last, box)
        return F.when(joins, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined(last, box)))).otherwise(F.concat(done, F.array(box)))

    return F.aggregate(lines, F.array().cast(f"array<{BOX}>"), step)


def box(text: Column) -> Column:
    return F.struct(F.col("line").cast("long").alias("line"), text.alias("text"), *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], F.col("confidence").cast("double").alias("confidence"), F.lit(1).cast("long").alias("n"))


def bubbles(lines: DataFrame) -> DataFrame:
    """Lines of one side that follow closely and align with the bubble so far make one bubble.

    Windows part the lines of a page wherever the side changes or a line stands too far below all
    that came before on its side; only within such a short stretch left edges are followed line by line.
    """
    order = Window.partitionBy("page").orderBy("y0", "x0", "line")
    turn = F.coalesce(F.col("who") != F.lag("who").over(order), F.lit(True))
    turned = side(lines).withColumn("_run", F.sum(turn.cast("int")).over(order))
    above = Window.partitionBy("page", "_run").orderBy("y0", "x0", "line").rowsBetween(Window.unboundedPreceding, -1)
    tall = F.col("y1") - F.col("y0")
    far = F.coalesce(F.col("y0") - F.max("y1").over(above) > LINE_GAP * tall, F.lit(True))
    parts = turned.withColumn("_far", far.cast("int")).withColumns({"_part": F.sum("_far").over(order), "_alone": (F.col("_far") == 1) & (F.coalesce(F.lead("_far").over(order), F.lit(1)) == 1)})
    sorted_ = F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "line", box(trim(F.col("text"))).alias("box")))), lambda x: x["box"])
    fits = lambda last, b: (b["y0"] - last["y1"] <= LINE_GAP * (b["y1"] - b["y0"])) & (F.abs(b["x0"] - last["x0"]) <= ALIGN)
    # A stretch of one line needs no fold.
    alone = parts.where("_alone").select("page", "_part", "who", F.lit(0).alias("_at"), box(trim(F.col("text"))).alias("b"))
    made = parts.where("NOT _alone").groupBy("page", "_part").agg(F.first("who").alias("who"), sorted_.alias("_lines")).select("page", "_part", "who", F.posexplode(boxes_of(F.col("_lines"), fits, lambda a, b: F.concat(a, F.lit("\n"), b))).alias("_at", "b"))
    place = F.row_number().over(Window.partitionBy("page").orderBy("_part", "_at")) - 1
    return made.union(alone).select("page", place.cast("long").alias("bubble"), "who", "b.text", "b.x0", "b.y0", "b.x1", "b.y1", F.col("b.n").alias("lines"), "b.confidence")


#: Heights of a tile of a tall picture and of what it shares with the next.
TILE, SHARED = 3000, 300


def tiles(pages: DataFrame) -> DataFrame:
    """(page, tile, top, bottom) from (page, height): the stretches in which a tall picture is read; they overlap, and the last ends with the picture."""
    step = TILE - SHARED
    last = F.greatest(F.ceil((F.col("height") - TILE) / step), F.lit(0)).cast("int")
    each = pages.select("page", "height", F.explode(F.sequence(F.lit(0), last)).alias("tile"))
    return each.select("page", "tile", (F.col("tile") * step).cast("double").alias("top"), F.least(F.col("height").cast("double"), (F.col("tile") * step + TILE).cast("double")).alias("bottom"))


def lines_of_tiles(read: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines of pages out of lines of their tiles (page, tile, ..., y0, y1 within the tile); what two tiles have read stays once."""
    placed = read.join(tiles(pages).select("page", "tile", "top"), ["page", "tile"])
    down = {c: F.col(c) + F.col("top") for c in ("y0", "y1")}
    return without_duplicates(placed.withColumns(down).drop("tile", "top"))


def without_duplicates(lines: DataFrame) -> DataFrame:
    """Lines of overlapping tiles once: of equal texts at the same place the surest stays, of equally sure ones the first.

    A line that has gone hides no other. Equal texts of a page meet in one array, from the surest down.
    """
    near = lambda a, b: (F.abs(a["x0"] - b["x0"]) <= SAME_PLACE) & (F.abs(a["y0"] - b["y0"]) <= SAME_PLACE)
    place = F.struct((-F.col("confidence")).alias("sure"), "line", "x0", "y0")
    kind = lines.select(place.alias("p")).schema["p"].dataType.simpleString()
    kept = F.aggregate(F.array_sort(F.collect_list(place)), F.array().cast(f"array<{kind}>"), lambda done, x: F.when(F.exists(done, lambda k: near(k, x)), done).otherwise(F.concat(done, F.array(x))))
    found = lines.groupBy("page", trim(F.col("text")).alias("_text")).agg(kept.alias("_kept"))
    return lines.join(found.select("page", F.explode("_kept").alias("_k")).select("page", F.col("_k.line").alias("line")), ["page", "line"], "left_semi").select(*lines.columns)


def message_key(who: Column, text: Column, kind: Column, time: Column) -> Column:
    """What makes two messages of different pages the same."""
    body = F.coalesce(F.regexp_replace(trim(text), r"\s+", " "), F.concat(F.lit("#"), kind))
    return F.concat_ws(" ", who, body, F.coalesce(time, F.lit("")))


def page_overlaps(paged: DataFrame) -> DataFrame:
    """From (chat, page, seq, key): how many messages each page repeats from the end of all that came before.

    The longest run of 15 to 2 messages that ends the pages so far, repeats left out, and begins the next; a
    single message is no overlap. The first page of a chat has no row. Of a page no more than its
    ends are carried along.
    """
    ordered = paged.groupBy("chat", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "key"))), lambda x: x["key"]).alias("keys"))
    first, last = F.slice("keys", F.lit(1), F.lit(MOST_OVERLAP)), F.slice("keys", F.lit(-MOST_OVERLAP), F.lit(MOST_OVERLAP))
    ends = F.when(F.size("keys") > 2 * MOST_OVERLAP, F.concat(first, last)).otherwise(F.col("keys"))
    pages = ordered.groupBy("chat").agg(F.array_sort(F.collect_list(F.struct("page", ends.alias("keys")))).alias("pages"))

    def repeated(tail: Column, keys: Column) -> Column:
        longest = F.least(F.lit(MOST_OVERLAP), F.size(keys), F.size(tail))
        sizes = F.when(longest >= LEAST_OVERLAP, F.sequence(longest, F.lit(LEAST_OVERLAP), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        return F.coalesce(F.get(F.filter(sizes, lambda k: F.slice(tail, -k, k) == F.slice(keys, F.lit(1), k)), F.lit(0)), F.lit(0))

    def add(state: Column, page: Column) -> Column:
        k = repeated(state["tail"], page["keys"])
        grown = F.concat(state["tail"], F.slice(page["keys"], k + 1, F.size(page["keys"])))
        tail = F.when(F.size(grown) > MOST_OVERLAP, F.slice(grown, F.lit(-MOST_OVERLAP), F.lit(MOST_OVERLAP))).otherwise(grown)
        return F.struct(tail.alias("tail"), F.concat(state["found"], F.array(F.struct(page["page"].alias("page"), k.alias("overlap")))).alias("found"))

    kind = ordered.schema["page"].dataType.simpleString()
    start = F.struct(F.array().cast("array<string>").alias("tail"), F.array().cast(f"array<struct<page:{kind},overlap:int>>").alias("found"))
    found = pages.select("chat", F.aggregate("pages", start, add)["found"].alias("found"))
    return found.select("chat", F.inline(F.slice("found", F.lit(2), F.greatest(F.size("found"), F.lit(1)))))


def page_gaps(paged: DataFrame) -> DataFrame:
    """(chat, page) of the pages that repeat nothing of what came before: something may be missing there."""
    return page_overlaps(paged).where("overlap = 0").select("chat", "page")


def merged_pages(paged: DataFrame) -> DataFrame:
    """Messages of all pages in order, repeated ones once; seq is counted anew."""
    order = Window.partitionBy("chat", "page").orderBy("seq")
    placed = paged.withColumn("_at", F.row_number().over(order)).join(page_overlaps(paged), ["chat", "page"], "left")
    kept = placed.where(F.col("_at") > F.coalesce("overlap", F.lit(0)))
    return kept.select("chat", "page", (F.row_number().over(Window.partitionBy("chat").orderBy("page", "_at")) - 1).alias("seq"), "key")


#: Fixed texts of the app's own controls.
CONTROLS = ("메시지 입력", "메시지를 입력하세요", "전송", "대화 상대 검색", "보내기")
TOP_SHARE, LEAST_HANGUL, STICKER = 0.12, 0.5, 1.8


def hangul_share(text: Column) -> Column:
    """Share of Korean letters among the characters that aren't white space."""
    plain = F.regexp_replace(text, r"\s", "")
    return F.when(F.length(plain) == 0, 0.0).otherwise(F.regexp_count(plain, F.lit("[가-힣ㄱ-ㅎㅏ-ㅣ]")) / F.length(plain))


def is_control(text: Column) -> Column:
    return F.exists(F.array(*map(F.lit, CONTROLS)), lambda c: F.startswith(trim(text), c))


def columns_kept(rows: DataFrame) -> Column:
    """Whether a line stands where bubbles do: the other's begin in one column, mine end in another or before it."""
    tolerance = F.greatest(F.lit(20.0), 0.05 * F.col("width"))
    top = (F.col("y0") + F.col("y1")) / 2 <= F.col("height") * TOP_SHARE
    mine = F.when(top, F.abs(F.col("x1") - F.col("_right")) <= tolerance).otherwise(F.col("x1") <= F.col("_right") + tolerance)
    theirs = F.abs(F.col("x0") - F.col("_left")) <= tolerance
    return F.coalesce(F.when(F.col("who") == "other", theirs).otherwise(mine), F.lit(True))


def prepared(lines: DataFrame) -> DataFrame:
    """Lines of (page, ..., height of the page) that belong to the conversation, with the reason of those that don't.

    Three steps, each over what the one before left: lines must begin in the other's column or end in mine;
    text much taller than the upper median of the rest is a sticker's; of the top of a page only labels
    and Korean text stay. Controls of the app count in the columns and go at the end.
    """
    text, tall = F.col("text"), F.col("y1") - F.col("y0")
    rows = side(lines).withColumns({"_time": time_label(text).isNotNull(), "_label": time_label(text).isNotNull() | date_label(text).isNotNull()})
    body = rows.where("NOT _label").select("page", "who", F.when(F.col("who") == "other", F.col("x0")).otherwise(F.col("x1")).alias("x"), reach().alias("tol"))
    at = lambda who: F.max(F.when(F.col("who") == who, F.col("column")))
    columns = densest(body, ["page", "who"]).groupBy("page").agg(at("other").alias("_left"), at("me").alias("_right"))
    rows = rows.join(columns, "page", "left")
    rows = rows.withColumn("_in", F.col("_label") | columns_kept(rows))
    rows = with_upper_median(rows, ["page"], F.when(F.col("_in") & ~F.col("_time"), tall), "_median")
    sticker = ~F.col("_time") & (F.col("_median") > 0) & (tall > F.col("_median") * STICKER)
    top = ~F.col("_label") & ((F.col("y0") + F.col("y1")) / 2 <= F.col("height") * TOP_SHARE) & (hangul_share(text) < LEAST_HANGUL)
    reason = F.when(~F.col("_in"), "column").when(sticker, "sticker").when(top, "top").when(is_control(text), "control")
    return rows.withColumn("dropped", reason).drop("_time", "_label", "_in", "_median", "_left", "_right")


def name_labels(lines: DataFrame) -> DataFrame:
    """(page, text) of short texts that repeat, only on the other's side, with a line of mine between: sender names.

    Between means by centres, strictly, and a time label is no line of mine: beside the other's
    bubble it stands on my side.
    """
    rows = side(lines).withColumns({"_text": trim(F.col("text")), "_y": (F.col("y0") + F.col("y1")) / 2})
    rows = rows.withColumn("_mine", ((F.col("who") == "me") & time_label(F.col("_text")).isNull()).cast("int"))
    upto = F.sum("_mine").over(Window.partitionBy("page").orderBy("_y").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_upto", upto).withColumn("_above", F.col("_upto") - F.sum("_mine").over(Window.partitionBy("page", "_y")))
    short = rows.where(F.length("_text").between(1, 12) & time_label(F.col("_text")).isNull() & date_label(F.col("_text")).isNull() & ~is_control(F.col("_text")))
    between = F.col("_above") > F.lag("_upto").over(Window.partitionBy("page", "_text").orderBy("_y"))
    found = short.withColumn("_turn", F.coalesce(between, F.lit(False))).groupBy("page", "_text").agg(F.bool_and(F.col("who") == "other").alias("theirs"), F.bool_or("_turn").alias("turned"))
    return found.where("theirs AND turned").select("page", F.col("_text").alias("text"))


def page_links(paged: DataFrame) -> DataFrame:
    """(chat, a, b, overlap) of pages of (chat, page, seq, key): messages at the end of a that begin b, 2 to 15.

    Hashes of the ends and of the beginnings of each length are joined, so that only pages
    which do overlap are met.
    """
    keys = paged.groupBy("chat", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "key"))), lambda x: x["key"]).alias("keys"))
    sizes = F.sequence(F.lit(LEAST_OVERLAP), F.least(F.lit(MOST_OVERLAP), F.size("keys")))
    sized = keys.where(F.size("keys") >= LEAST_OVERLAP).select("chat", "page", "keys", F.explode(sizes).alias("k"))
    digest = lambda part: F.md5(F.to_json(F.struct(part.alias("part"))).cast("binary"))
    ends = sized.select("chat", "k", digest(F.slice("keys", -F.col("k"), F.col("k"))).alias("run"), F.col("page").alias("a"))
    starts = sized.select("chat", "k", digest(F.slice("keys", F.lit(1), F.col("k"))).alias("run"), F.col("page").alias("b"))
    return ends.join(starts, ["chat", "k", "run"]).where("a <> b").groupBy("chat", "a", "b").agg(F.max("k").alias("overlap"))


#: Up to so many pages of a chat every order is weighed; beyond, pages are chained by their largest overlaps.
ALL_ORDERS = 8


def best_order(n: int, links: dict[tuple[int, int], int]) -> list[int]:
    """The order of pages 0 to n - 1 with the largest sum of overlaps of neighbours; the given one unless another beats it."""
    score = lambda order: sum(links.get(x, 0) for x in zip(order, order[1:], strict=False))
    given = list(range(n))
    if n <= ALL_ORDERS:

        @cache
        def rest(last: int, left: int) -> int:
            """The most that the pages in the bits of ``left`` can add behind ``last``."""
            return max((links.get((last, j), 0) + rest(j, left & ~(1 << j)) for j in range(n) if left >> j & 1), default=0)

        order, left = [], (1 << n) - 1
        while left:
            add = lambda j: (links.get((order[-1], j), 0) if order else 0) + rest(j, left & ~(1 << j))  # noqa: B023, E731
            order.append(max((j for j in given if left >> j & 1), key=lambda j: (add(j), -j)))
            left &= ~(1 << order[-1])
    else:
        into, out = [0] * n, defaultdict(list)
        for (a, b), k in links.items():
            into[b] = max(into[b], k)
            out[a].append((-k, b))
        order, left = [into.index(min(into))], dict.fromkeys(given)
        left.pop(order[0])
        while left:
            order.append(min((x for x in out[order[-1]] if x[1] in left), default=(0, next(iter(left))))[1])
            left.pop(order[-1])
    return order if score(order) > score(given) else given


def page_order(paged: DataFrame) -> DataFrame:
    """(chat, page, place): pages of (chat, page, seq, key) in the order that their overlaps tell, else as they are.

    Only a chat's pages and its overlapping pairs meet in one task.
    """
    kind = paged.schema["chat"].dataType.simpleString(), paged.schema["page"].dataType.simpleString()

    def placed(rows: pd.DataFrame) -> pd.DataFrame:
        pages = sorted(rows.loc[rows["overlap"].isna(), "a"])
        at = {p: i for i, p in enumerate(pages)}
        linked = rows[rows["overlap"].notna()]
        order = best_order(len(pages), {(at[a], at[b]): int(k) for a, b, k in zip(linked["a"], linked["b"], linked["overlap"], strict=True)})
        return pd.DataFrame({"chat": rows["chat"].iloc[0], "page": [pages[i] for i in order], "place": range(len(order))})

    pages = paged.select("chat", F.col("page").alias("a")).distinct().withColumns({"b": F.col("a"), "overlap": F.lit(None).cast("int")})
    return pages.unionByName(page_links(paged)).groupBy("chat").applyInPandas(placed, f"chat {kind[0]}, page {kind[1]}, place long")


def reordered(paged: DataFrame) -> DataFrame:
    """Pages of (chat, page, seq, key) numbered anew, in the order of ``page_order``."""
    return paged.join(page_order(paged), ["chat", "page"]).select("chat", F.col("place").alias("page"), "seq", "key")
