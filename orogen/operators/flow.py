"""Surface flow on rasters: D8 receivers, accumulation, basins, streams and filled depressions."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orogen.functions.loops import checkpointed, fixpoint
from orogen.operators.raster import NEIGHBOURS, stencil, tiles

#: Order in which equal drops are decided, and the powers of two of the codes: E, SE, S, SW, W, NW, N, NE.
ORDER = {name: (k, dr, dc) for k, (name, dr, dc) in enumerate(NEIGHBOURS)}


def receivers(cells: DataFrame, ny: int, nx: int, cell: float = 1.0) -> DataFrame:
    """cell (row * nx + col), down (the steepest lower neighbour, the first of equals in E..NE order, or null) and code (2^k, 0 for sinks).

    Off the frame is a wall. A nodata neighbour is deeper than any other: the first of them draws the flow out of the raster, so the
    cell keeps the code of that way, but has no receiver.
    """
    s = stencil(cells, ny, nx).where("z is not null")
    options = []
    for name, (k, dr, dc) in ORDER.items():
        lost = (F.col("row") + dr).between(0, ny - 1) & (F.col("col") + dc).between(0, nx - 1) & F.col(name).isNull()
        drop = F.when(lost, float("inf")).otherwise((F.col("z") - F.col(name)) / (cell * (math.sqrt(2) if dr and dc else 1.0)))
        down = F.when(~lost, ((F.col("row") + dr) * nx + F.col("col") + dc).cast("long"))
        options.append(F.when(drop > 0, F.struct(drop.alias("drop"), F.lit(-k).alias("k"), down.alias("down"))))
    cell_no = (F.col("row") * nx + F.col("col")).cast("long").alias("cell")
    return s.select(cell_no, F.greatest(*options).alias("b")).select("cell", "b.down", F.coalesce(F.expr("shiftleft(1, -b.k)"), F.lit(0)).alias("code"))


def _local(down: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What drains through each cell of a tile, and the cell where its water leaves the tile or ends; ``down`` is a place in the tile, or -1."""
    n = len(down)
    total, last = weight.astype(np.int64), np.arange(n)
    ptr = np.append(np.where(down < 0, n, down), n)
    end = np.append(np.where(down < 0, last, down), n)
    while (ptr[:n] < n).any():
        moving = ptr[:n] < n
        got = np.zeros(n, np.int64)
        np.add.at(got, ptr[:n][moving], total[moving])
        total = total + got
        ptr = ptr[ptr]
        end = end[end]
    return total, end[:n]


def _in_tiles(flow: DataFrame, nx: int, tile: int) -> DataFrame:
    return flow.withColumn("tr", F.expr(f"cell div {nx} div {tile}")).withColumn("tc", F.expr(f"cell % {nx} div {tile}"))


def _tiled(frame: pd.DataFrame, weight: np.ndarray) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """A tile's frame by cell, whether each cell's receiver is outside, what drains through it and where its water ends in the tile."""
    order = frame["cell"].to_numpy().argsort()
    frame, weight = frame.iloc[order], weight[order]
    cell, down = frame["cell"].to_numpy(), frame["down"].fillna(-1).to_numpy().astype(np.int64)
    at = np.minimum(np.searchsorted(cell, down), len(cell) - 1)
    inside = cell[at] == down
    total, end = _local(np.where(inside, at, -1), weight)
    return frame, (down >= 0) & ~inside, total, end


def _exits(flow: DataFrame, nx: int, tile: int) -> DataFrame:
    """The cells whose receiver lies in another tile: cell, down, acc (what drains through it inside its tile) and next (the exit, or the end, that its water comes to next)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame, leaves, total, end = _tiled(frame, np.ones(len(frame), np.int64))
        cell = frame["cell"].to_numpy()
        r, c = cell // nx % tile, cell % nx % tile
        rim = leaves | np.isin(r, (0, tile - 1)) | np.isin(c, (0, tile - 1))
        return pd.DataFrame({"cell": cell, "down": frame["down"].to_numpy(), "acc": total, "end": cell[end], "leaves": leaves})[rim]

    rim = checkpointed(_in_tiles(flow.select("cell", "down"), nx, tile).groupBy("tr", "tc").applyInPandas(run, "cell long, down long, acc long, end long, leaves boolean"))
    entered = rim.select(F.col("cell").alias("down"), F.col("end").alias("next"))
    return rim.where("leaves").join(entered, "down", "left").select("cell", "down", "acc", "next")


def basins(flow: DataFrame, nx: int | None = None, tile: int = 256) -> DataFrame:
    """cell, outlet (where its water ends) and basin (outlets numbered by cell), by pointer jumping: a path of n cells takes log2(n) rounds.

    With ``nx``, the columns of the frame, tiles follow their own cells first, so rounds are over the cells where water passes from tile to tile.
    """
    if nx is not None:
        crossing = checkpointed(_exits(flow, nx, tile))
        still = crossing.select(F.col("next").alias("cell")).distinct().join(crossing.select("cell"), "cell", "left_anti")
        ends = checkpointed(basins(crossing.select("cell", F.col("next").alias("down")).union(still.select("cell", F.lit(None).cast("long")))))

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            frame, _, _, end = _tiled(frame, np.ones(len(frame), np.int64))
            cell = frame["cell"].to_numpy()
            return pd.DataFrame({"cell": cell, "end": cell[end]})

        local = _in_tiles(flow.select("cell", "down"), nx, tile).groupBy("tr", "tc").applyInPandas(run, "cell long, end long")
        return local.join(ends.select(F.col("cell").alias("end"), "outlet"), "end", "left").select("cell", F.coalesce("outlet", "end").alias("outlet"))
    jump = lambda t: t.select("cell", "ptr").join(t.select(F.col("cell").alias("ptr"), F.col("ptr").alias("next")), "ptr").select("cell", F.col("next").alias("ptr"), (F.col("next") != F.col("ptr")).alias("moved"))
    ends = fixpoint(flow.select("cell", F.coalesce("down", "cell").alias("ptr")), jump, lambda t: t.where("moved"))
    return ends.select("cell", F.col("ptr").alias("outlet"))


def accumulation(flow: DataFrame, nx: int | None = None, tile: int = 256) -> DataFrame:
    """cell and acc, the cells that drain through it, itself included.

    With ``nx``, the columns of the frame (receivers are neighbours then), tiles add up their own cells first; what passes from tile to tile is a small graph of
    crossings, summed by pointer doubling; then tiles add up once more with what comes in: two shuffles of cells, and rounds over crossings only.
    """
    if nx is None:
        return _doubled(flow.select("cell", F.col("down").alias("ptr"), F.lit(1).cast("long").alias("acc")))
    crossing = checkpointed(_exits(flow, nx, tile))
    # An exit's water comes to the next exit of the tile it enters; where it ends inside, the way is over.
    inner = crossing.select(F.col("cell").alias("next"), F.lit(True).alias("goes_on"))
    ways = crossing.join(inner, "next", "left").select("cell", F.when(F.col("goes_on"), F.col("next")).alias("ptr"), "acc")
    passing = crossing.select("cell", F.col("down").alias("into")).join(_doubled(ways), "cell").groupBy(F.col("into").alias("cell")).agg(F.sum("acc").alias("inflow"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        weight = 1 + frame["inflow"].fillna(0).to_numpy().astype(np.int64)
        frame, _, total, _ = _tiled(frame, weight)
        return pd.DataFrame({"cell": frame["cell"].to_numpy(), "acc": total})

    fed = flow.select("cell", "down").join(passing, "cell", "left")
    return _in_tiles(fed, nx, tile).groupBy("tr", "tc").applyInPandas(run, "cell long, acc long")


def _doubled(start: DataFrame) -> DataFrame:
    """cell and acc of pointers (cell, ptr, acc), each cell with all that its pointers bring.

    Pointer doubling: after round k every cell has summed what drains to it over fewer than 2^k
    steps, and points 2^k steps down. Each round joins once and adds up by receiver.
    """
    now = checkpointed(start)
    while not now.where("ptr is not null").isEmpty():
        sent = now.where("ptr is not null").groupBy(F.col("ptr").alias("cell")).agg(F.sum("acc").alias("got"))
        far = now.select(F.col("cell").alias("ptr"), F.col("ptr").alias("far"))
        now = checkpointed(now.join(sent, "cell", "left").join(far, "ptr", "left").select("cell", F.col("far").alias("ptr"), (F.col("acc") + F.coalesce("got", F.lit(0))).alias("acc")))
    return now.select("cell", "acc")


def climb(pointers: DataFrame) -> DataFrame:
    """cell, root and dist (steps to it) of pointers (cell, ptr; a root points to itself), by pointer jumping."""
    def jump(t: DataFrame) -> DataFrame:
        far = t.select(F.col("cell").alias("ptr"), F.col("ptr").alias("next"), F.col("dist").alias("more"))
        joined = t.select("cell", "ptr", "dist").join(far, "ptr")
        return joined.select("cell", F.col("next").alias("ptr"), (F.col("dist") + F.col("more")).alias("dist"), (F.col("next") != F.col("ptr")).alias("moved"))

    start = pointers.select("cell", "ptr", (F.col("cell") != F.col("ptr")).cast("long").alias("dist"))
    return fixpoint(start, jump, lambda t: t.where("moved")).select("cell", F.col("ptr").alias("root"), "dist")


def _chains(follow: DataFrame, nx: int, tile: int) -> DataFrame:
    """cell, root (the first cell of its chain) and dist (steps from it) of cells (cell, next) that follow one another, one another at most: inside tiles first, then from tile to tile."""
    from orogen.operators.lines import chained  # which builds on this module

    place = F.expr(f"(cell div {nx} div {tile}) * {1 << 24} + cell % {nx} div {tile}").alias("tile")
    return chained(follow.select(F.col("cell").alias("id"), "next", place)).select(F.col("id").alias("cell"), F.col("line").alias("root"), F.col("seq").alias("dist"))


def stream_cells(flow: DataFrame, acc: DataFrame, threshold: float, nx: int | None = None, tile: int = 256) -> DataFrame:
    """cell, down, acc, link and dist of the cells through which at least ``threshold`` cells drain.

    A link begins at a head or where streams meet, and is named by that cell; ``dist`` counts the steps from it. Links come
    from pointers to the one cell upstream, so long streams take as many rounds as the logarithm of their length. With ``nx``, the columns of
    the frame, tiles follow their own streams first, so rounds are over the stretches between tiles.
    """
    net = flow.join(acc.where(F.col("acc") >= threshold), "cell").select("cell", "down", "acc")
    if nx is not None:
        net = checkpointed(net)
        single = net.where("down is not null").groupBy(F.col("down").alias("next")).agg(F.count("*").alias("n")).where("n = 1").join(net.select(F.col("cell").alias("next")), "next", "left_semi")
        follow = net.select("cell", F.col("down").alias("next")).join(single, "next", "left").select("cell", F.when(F.col("n").isNotNull(), F.col("next")).alias("next"))
        return net.join(_chains(follow, nx, tile), "cell").select("cell", "down", "acc", F.col("root").alias("link"), "dist")
    up = net.select(F.col("down").alias("cell"), F.col("cell").alias("up")).where("cell is not null").join(net.select("cell"), "cell", "left_semi")
    inflow = up.groupBy("cell").agg(F.count("*").alias("inflows"), F.min("up").alias("up"))
    pointer = F.when(F.col("inflows") == 1, F.col("up")).otherwise(F.col("cell"))
    roots = climb(net.join(inflow, "cell", "left").select("cell", F.coalesce(pointer, "cell").alias("ptr")))
    return net.join(roots, "cell").select("cell", "down", "acc", F.col("root").alias("link"), "dist")


def _orders(links: DataFrame, nx: int, tile: int = 256) -> DataFrame:
    """link and order of links (link, next, which it runs into, or null): tiles settle their own links, as far as orders have come in, so rounds follow links from tile to tile."""
    fed = links.where("next is not null").select(F.col("next").alias("link")).distinct().withColumn("fed", F.lit(True))
    now = links.join(fed, "link", "left").select("link", "next", F.when(F.col("fed").isNull(), F.lit(1)).alias("order"))

    def settled(frame: pd.DataFrame) -> pd.DataFrame:
        known, above = {}, {}
        for link, up, order in zip(frame["link"].tolist(), frame["up"].tolist(), frame["order"].fillna(0).astype(int).tolist(), strict=True):
            above.setdefault(link, []).append(up)
            if order:
                known[up] = order
        into = {up: link for link, ups in above.items() for up in ups}
        out, ready = {}, list(above)
        while ready:
            link = ready.pop()
            orders = [known.get(up, 0) for up in above[link]]
            if link in out or 0 in orders:
                continue
            top = max(orders)
            out[link] = known[link] = top + (orders.count(top) > 1)
            if into.get(link) in above:
                ready.append(into[link])
        return pd.DataFrame({"link": list(out), "found": list(out.values())}).astype({"link": "int64", "found": "int32"})

    place = [F.expr(f"link div {nx} div {tile}").alias("tr"), F.expr(f"link % {nx} div {tile}").alias("tc")]

    def step(t: DataFrame) -> DataFrame:
        edges = t.where("next is not null").select(F.col("next").alias("link"), F.col("link").alias("up"), "order")
        got = edges.select("link", "up", "order", *place).groupBy("tr", "tc").applyInPandas(settled, "link long, found int")
        return t.join(got, "link", "left").select("link", "next", F.coalesce("order", "found").alias("order"))

    return fixpoint(now, step, lambda t: t.where("order is null"), 10_000).select("link", "order")


def stream_links(cells: DataFrame, nx: int | None = None) -> DataFrame:
    """link, end, n_cells, acc_out and order of the links of ``stream_cells``.

    A link ends on the cell where it meets others, or where it leaves the network. Heads have order 1; where two inflows or
    more share the highest order, the next link has one more. Orders settle link by link, in as many rounds as links follow one another; with ``nx``, the columns of
    the frame, tiles settle their own links first.
    """
    inside = cells.select(F.col("cell").alias("down"), F.col("acc").alias("acc_down"))
    last = cells.groupBy("link").agg(F.max_by(F.struct("cell", "down", "acc"), "dist").alias("l"), F.count("*").alias("n")).select("link", "l.*", "n").join(inside, "down", "left")
    met = F.col("acc_down").isNotNull()
    links = checkpointed(last.select("link", F.when(met, F.col("down")).otherwise(F.col("cell")).alias("end"), met.alias("met"), (F.col("n") + met.cast("int")).alias("n_cells"), F.coalesce("acc_down", "acc").alias("acc_out")))
    if nx is not None:
        return links.join(_orders(links.select("link", F.when(F.col("met"), F.col("end")).alias("next")), nx), "link").drop("met")
    above = checkpointed(links.where("met").select(F.col("end").alias("link"), F.col("link").alias("up")))
    need = above.groupBy("link").agg(F.count("*").alias("need"))
    done = checkpointed(links.join(need, "link", "left_anti").select("link", F.lit(1).alias("order")))
    while True:
        orders = above.join(done.select("link"), "link", "left_anti").join(done.select(F.col("link").alias("up"), "order"), "up").groupBy("link", "order").agg(F.count("*").alias("k"))
        best = orders.groupBy("link").agg(F.sum("k").alias("have"), F.max(F.struct("order", "k")).alias("top"))
        ready = best.join(need, "link").where("have = need").select("link", (F.col("top.order") + (F.col("top.k") > 1).cast("int")).alias("order"))
        ready = checkpointed(ready)
        if ready.isEmpty():
            return links.join(done, "link").drop("met")
        done = checkpointed(done.union(ready))


def strahler(flow: DataFrame, streams: DataFrame, nx: int | None = None) -> DataFrame:
    """cell and order of stream cells (cell): those of their links, so that rounds follow links and not cells; with ``nx``, the columns of the frame, links are followed by tiles."""
    cells = checkpointed(stream_cells(flow, streams.select("cell", F.lit(1).alias("acc")), 1, nx))
    return cells.join(stream_links(cells, nx).select("link", "order"), "link").select("cell", "order")


def river_network(flow: DataFrame, acc: DataFrame, threshold: float, nx: int | None = None) -> DataFrame:
    """link, end, n_cells, acc_out and order of the links of two cells or more of a river network; with ``nx``, the columns of the frame, links are followed by tiles."""
    return stream_links(checkpointed(stream_cells(flow, acc, threshold, nx)), nx).where("n_cells >= 2")


def snap(points: DataFrame, acc: DataFrame, ny: int, nx: int, radius: int) -> DataFrame:
    """id and cell: the cell through which most drains in the square window of ``radius`` cells around each point (id, row, col), the first in row order of equals."""
    held = lambda c, n: F.greatest(F.lit(0), F.least(c, F.lit(n - 1)))
    p = points.select("id", held(F.col("row"), ny).alias("row"), held(F.col("col"), nx).alias("col"))
    span = lambda c, n: F.sequence(F.greatest(F.lit(0), F.col(c) - radius), F.least(F.lit(n - 1), F.col(c) + radius))
    near = p.select("id", F.explode(span("row", ny)).alias("r"), span("col", nx).alias("cs")).select("id", "r", F.explode("cs").alias("c"))
    near = near.select("id", (F.col("r") * nx + F.col("c")).cast("long").alias("cell")).join(acc.hint("merge"), "cell")  # windows are more rows than any estimate of the points tells
    return near.groupBy("id").agg(F.min(F.struct(-F.col("acc"), "cell"))["cell"].alias("cell"))


def catchments(flow: DataFrame, seeds: DataFrame, nx: int | None = None) -> DataFrame:
    """cell and seed: the first seed (cell) on each cell's way down, for cells that pass one. With ``nx``, the columns of the frame, tiles follow their own cells first, as ``basins`` does."""
    marked = flow.select("cell", "down").join(seeds.select("cell", F.lit(True).alias("seed")).distinct(), "cell", "left")
    if nx is not None:
        ends = basins(checkpointed(marked.select("cell", F.when(F.col("seed").isNull(), F.col("down")).alias("down"))), nx)
        return ends.join(seeds.select(F.col("cell").alias("outlet")).distinct(), "outlet", "left_semi").select("cell", F.col("outlet").alias("seed"))
    own = F.when(F.col("seed"), F.col("cell")).otherwise(F.coalesce("down", "cell"))
    ends = climb(marked.select("cell", own.alias("ptr")))
    return ends.join(seeds.select(F.col("cell").alias("root")).distinct(), "root", "left_semi").select("cell", F.col("root").alias("seed"))


def main_streams(flow: DataFrame, acc: DataFrame, seeds: DataFrame, nx: int, tile: int = 256) -> DataFrame:
    """seed, cell and step: the way up from each seed, always to the neighbour through which most drains, the first in E..NE order of equals.

    Tiles follow their own ways first, so rounds are over the stretches between tiles.
    """
    dr, dc = F.expr(f"(cell div {nx}) - (down div {nx})"), F.expr(f"(cell % {nx}) - (down % {nx})")
    turn = F.coalesce(*[F.when((dr == r) & (dc == c), k) for k, r, c in ORDER.values()])
    feeds = flow.where("down is not null").join(acc, "cell").select("cell", "down", "acc", turn.alias("k"))
    best = feeds.groupBy("down").agg(F.min(F.struct(-F.col("acc"), "k", "cell"))["cell"].alias("cell"))
    seed = seeds.select("cell").distinct()
    ahead = best.join(seed, "cell", "left_anti").select(F.col("cell").alias("next"), F.col("down").alias("cell"))
    every = checkpointed(flow.select("cell").join(ahead, "cell", "left").select("cell", "next"))
    return _chains(every, nx, tile).join(seed.select(F.col("cell").alias("root")), "root", "left_semi").select(F.col("root").alias("seed"), "cell", F.col("dist").alias("step"))


def gauge_report(cells: DataFrame, flow: DataFrame, acc: DataFrame, seeds: DataFrame, ny: int, nx: int, cell: float, interval: float = 0.0, threshold: float = 0.0) -> DataFrame:
    """Of the catchment of each seed (cell): cells, area, heights, main stream and slopes; and with ``interval`` and ``threshold`` contours and network.

    Contour length counts a cell's side for each two neighbours inside that lie between different contours; the slope of
    the sides is interval * length / (2 area), in thousandths. The weighted slope of the stream is the product of its
    reaches' slopes to the power of their share of its length; reaches end where the profile's curvature changes sign, and level
    ones don't count. The network is the steps between two cells inside through which ``threshold`` cells drain.
    What isn't known is null. Seeds of nested catchments part the cells between them.
    """
    z = cells.select((F.col("row") * nx + F.col("col")).cast("long").alias("cell"), "row", "col", "z")
    area = checkpointed(catchments(flow, seeds, nx).join(z, "cell").join(acc, "cell").join(flow.select("cell", "down"), "cell"))
    base = area.groupBy("seed").agg(
        F.count("*").alias("cells"), (F.count("*") * cell * cell / 1e6).alias("area_km2"), F.avg("z").alias("z_mean"), F.min("z").alias("z_min"),
        F.max("z").alias("z_max"), F.max(F.when(F.col("cell") == F.col("seed"), F.col("z"))).alias("z_gauge"),
    )
    step = F.sqrt(F.pow(F.expr(f"(down div {nx}) - (cell div {nx})"), F.lit(2)) + F.pow(F.expr(f"(down % {nx}) - (cell % {nx})"), F.lit(2))) * cell
    if interval > 0:
        level = F.floor(F.col("z") / interval)
        side = lambda by, along: F.when((F.lead(along).over(Window.partitionBy("seed", by).orderBy(along)) == F.col(along) + 1), (F.lead(level).over(Window.partitionBy("seed", by).orderBy(along)) != level).cast("int"))
        lines = area.select("seed", (F.coalesce(side("row", "col"), F.lit(0)) + F.coalesce(side("col", "row"), F.lit(0))).alias("k")).groupBy("seed").agg((F.sum("k") * cell).alias("iso"))
        base = base.join(lines, "seed").withColumn("sp_iso_km", F.col("iso") / 1000).withColumn("sp_slope_ppm", interval * F.col("iso") / (2 * F.col("cells") * cell * cell) * 1000).drop("iso")
    if threshold > 0:
        net = area.where(F.col("acc") >= threshold)
        both = net.withColumn("step", step).join(net.select("seed", F.col("cell").alias("down")), ["seed", "down"], "left_semi")
        found = both.groupBy("seed").agg((F.sum("step") / 1000).alias("net"))
        base = base.join(found, "seed", "left").withColumn("net_km", F.coalesce("net", F.lit(0.0))).withColumn("net_dens", F.col("net_km") / F.col("area_km2")).drop("net")
    way = main_streams(flow, acc, seeds, nx).join(z.select("cell", "z"), "cell").join(flow.select("cell", "down"), "cell")
    way = way.withColumn("step_m", F.when(F.col("step") > 0, step).otherwise(0.0))
    total = way.groupBy("seed").agg(F.sum("step_m").alias("length"), F.max("step").alias("n"), F.max_by("z", "step").alias("top"), F.min_by("z", "step").alias("foot"))
    order = Window.partitionBy("seed").orderBy(F.desc("step"))
    bend = F.lead("z").over(order) - 2 * F.col("z") + F.lag("z").over(order)
    known = way.where("z is not null").withColumn("k", F.row_number().over(order)).withColumn("bend", bend).withColumn("next_bend", F.lead("bend").over(order)).withColumn("left", F.lead("k").over(order))
    turns = known.where((F.col("k") == 1) | F.col("left").isNull() | (F.col("bend") * F.col("next_bend") < 0))
    reach = turns.select("seed", "k", "z", F.lead("k").over(Window.partitionBy("seed").orderBy("k")).alias("k2"), F.lead("z").over(Window.partitionBy("seed").orderBy("k")).alias("z2")).where("k2 is not null")
    reach = reach.join(known.groupBy("seed").agg(F.count("*").alias("places")), "seed").join(total.select("seed", "length"), "seed")
    li = F.col("length") / (F.col("places") - 1) * (F.col("k2") - F.col("k"))
    slope = F.abs(F.col("z2") - F.col("z")) / li
    weighted = reach.groupBy("seed").agg(F.sum(F.when(slope > 0, li / F.col("length") * F.log(slope))).alias("l")).select("seed", F.when(F.col("l") != 0, F.exp("l") * 1000).alias("sp_stream_ppm"))
    stream = total.where("length > 0").join(weighted, "seed", "left").select(
        "seed", (F.col("length") / 1000).alias("stream_km"), (F.col("top") - F.col("foot")).alias("stream_fall_m"),
        ((F.col("top") - F.col("foot")) / F.col("length") * 1000).alias("stream_ppm"), "sp_stream_ppm",
    )
    return base.join(stream, "seed", "left")


def fill(cells: DataFrame, ny: int, nx: int, eps: float = 0.001, tile: int = 256, rounds: int = 10_000) -> DataFrame:
    """Heights raised so that every cell drains (Planchon and Darboux): the least surface at or above z that falls by ``eps`` a step to an outlet.

    The frame's edge and cells next to nodata are outlets. The first round settles every tile from its own outlets, lowest first; each later one only goes on from
    those cells around a tile that have been lowered since. It ends when no tile has lowered a cell on its rim, after as many rounds as the longest way out crosses tiles.
    """
    s = stencil(cells, ny, nx)
    gone, ways = F.lit(False), [(dr, dc) for _, dr, dc in ORDER.values()]
    for n in ORDER:
        gone = gone | F.col(n).isNull()
    start = F.when(gone, F.col("z")).otherwise(F.lit(float("inf")))
    now = s.where("z is not null").select("row", "col", F.col("z").cast("double").alias("z"), start.cast("double").alias("w"), F.lit(2).cast("byte").alias("moved"))

    def settled(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        # 2: an outlet that has not been gone on from; 1: lowered in the round before, which its own tile knows; 0: as before.
        own = ((frame["row"] // tile == key[0]) & (frame["col"] // tile == key[1])).to_numpy()
        fresh = np.where(own, frame["moved"] == 2, frame["moved"] > 0) & np.isfinite(frame["w"].to_numpy())
        if not fresh.any():
            return frame[own].assign(moved=np.int8(0))
        top, left = key[0] * tile - 1, key[1] * tile - 1
        z, w = np.full((tile + 2, tile + 2), np.nan), np.full((tile + 2, tile + 2), np.inf)
        at = (frame["row"].to_numpy() - top, frame["col"].to_numpy() - left)
        z[at], w[at] = frame["z"].to_numpy(), frame["w"].to_numpy()
        before, inner = w.copy(), np.isfinite(z)
        inner[[0, -1]] = inner[:, [0, -1]] = False
        first = (at[0][fresh], at[1][fresh])
        z, inner, w = z.tolist(), inner.tolist(), w.tolist()
        heap = [(w[i][j], i, j) for i, j in zip(first[0].tolist(), first[1].tolist(), strict=True)]
        heapq.heapify(heap)
        while heap:
            low, i, j = heapq.heappop(heap)
            if low > w[i][j]:
                continue
            for dr, dc in ways:
                a, b = i + dr, j + dc
                if 0 <= a <= tile + 1 and 0 <= b <= tile + 1 and inner[a][b]:
                    new = max(z[a][b], low + eps)
                    if new < w[a][b]:
                        w[a][b] = new
                        heapq.heappush(heap, (new, a, b))
        w = np.array(w)
        rim = np.isin(at[0], (1, tile)) | np.isin(at[1], (1, tile))
        # Outlets on the rim are news to the tiles around too, but those have had them as outlets in this same round.
        return frame[own].assign(w=w[at][own], moved=((w != before)[at] & rim)[own].astype(np.int8))

    step = lambda t: tiles(t, tile, 1).groupBy("tr", "tc").applyInPandas(lambda key, f: settled(key, f)[["row", "col", "z", "w", "moved"]], now.schema)
    return fixpoint(now, step, lambda t: t.where("moved > 0"), rounds).select("row", "col", F.col("w").alias("z"))


def trace(flow: DataFrame, starts: DataFrame, stop: DataFrame | None = None, merge: bool = False) -> DataFrame:
    """start, step and cell of the ways downhill from ``starts`` (cell), up to a cell of ``stop`` (cell) that they come to.

    A start on such a cell goes on. With ``merge`` a way ends on the first cell after its start that a way from a lesser start has
    passed. Ways double their length each round: a table of cells 2^k steps down continues all places known so far.
    """
    down = flow.select("cell", "down").where("down is not null")
    begun = starts.select(F.col("cell").alias("start")).distinct()
    firsts = begun.join(down.withColumnRenamed("cell", "start"), "start").select("start", F.lit(1).cast("long").alias("step"), F.col("down").alias("cell"))
    if stop is not None:
        held = stop.select("cell", F.lit(True).alias("held")).distinct()
        down = down.join(held, "cell", "left").select("cell", F.when(F.col("held").isNull(), F.col("down")).alias("down"))
    far = checkpointed(down.where("down is not null"))
    out = checkpointed(firsts)
    reach = 1
    while not far.isEmpty():
        longer = out.join(far, "cell").select("start", (F.col("step") + reach).alias("step"), F.col("down").alias("cell"))
        out = checkpointed(out.union(longer))
        far = checkpointed(far.join(far.select(F.col("cell").alias("down"), F.col("down").alias("next")), "down").select("cell", F.col("next").alias("down")))
        reach *= 2
    out = out.union(begun.select("start", F.lit(0).cast("long").alias("step"), F.col("start").alias("cell")))
    if merge:
        owner = out.groupBy("cell").agg(F.min("start").alias("owner"))
        known = out.join(owner, "cell")
        first = known.where((F.col("owner") != F.col("start")) & (F.col("step") > 0)).groupBy("start").agg(F.min("step").alias("last"))
        out = known.join(first, "start", "left").where(F.col("last").isNull() | (F.col("step") <= F.col("last"))).select("start", "step", "cell")
    return out


def trace_metrics(ways: DataFrame, cells: DataFrame, flow: DataFrame, ny: int, nx: int, cell: float, stop: DataFrame | None = None) -> DataFrame:
    """start, cells, length, drop, slope and reason (receiver, merge, edge or sink) of each way of ``trace``."""
    z = cells.select((F.col("row") * nx + F.col("col")).cast("long").alias("cell"), "row", "col", "z")
    w = Window.partitionBy("start").orderBy("step")
    laid = ways.join(z, "cell").withColumn("r", F.lag("row").over(w)).withColumn("c", F.lag("col").over(w))
    length = F.sqrt(F.pow(F.col("row") - F.col("r"), F.lit(2)) + F.pow(F.col("col") - F.col("c"), F.lit(2))) * cell
    ends = laid.groupBy("start").agg(F.count("*").alias("cells"), F.coalesce(F.sum(length), F.lit(0.0)).alias("length"), F.min_by("z", "step").alias("z0"), F.max_by(F.struct("cell", "row", "col", "z"), "step").alias("last"))
    ends = ends.withColumn("cell", F.col("last.cell")).join(flow.select("cell", "down"), "cell")
    received = ends.select("cell").limit(0).withColumn("held", F.lit(True)) if stop is None else stop.select("cell", F.lit(True).alias("held")).distinct()
    edge = F.col("last.row").isin(0, ny - 1) | F.col("last.col").isin(0, nx - 1)
    reason = F.when(F.col("held"), "receiver").when(F.col("down").isNotNull(), "merge").when(edge, "edge").otherwise("sink")
    drop = F.col("z0") - F.col("last.z")
    return ends.join(received, "cell", "left").select("start", "cells", "length", drop.alias("drop"), F.coalesce(F.try_divide(drop, F.col("length")), F.lit(0.0)).alias("slope"), reason.alias("reason"))
