"""HTML extraction by union-free regular expressions.

A page's token stream is its tags and texts. The pages of a host are aligned: streams are folded (a group that repeats side
by side becomes one repeated group) and merged one after another into a wrapper; where the wrapper and a stream disagree,
what only one of them has becomes an optional group, and a text becomes a slot. A wrapper is a list of nodes: a tag, the
slot `#`, a fixed text `=key`, and groups `(kind, nodes)` with kind `+` (repeated) or `?` (optional). It has no
alternatives.

A text that stands at the same place among its open tags on nearly all different pages of a host (FIXED_SHARE, at least
LEAST_PAGES pages) is fixed: it is a token of the wrapper like a tag is, and is never main text. All other texts are slots.
Every slot gets its role from the wrapper's tags around it: main text lies in the article (or main element, or the body if
no page of the host has either), outside menus, headers, footers, sidebars, notices, adverts, forms, scripts and
comments. Extraction looks a text up in the host's fixed texts, then its place among its open tags in the host's slots; a
place that no wrapper has (a page that was not in the fit) gets its role by the same rule.

The fit sees every page: different streams are counted per host, texts are counted over them, and distinct folded streams
are merged in rounds, about FAN of a host at a time, until a host has one wrapper. Pages are never dealt out by host: the
wrappers go to the pages, all of them if they are small (BROADCAST_BYTES, checked), else by a join.

Defined results: null or empty html gives an empty text; a null url is a host of its own; markup that breaks off is read as
far as it goes; repeated rows give equal results; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import difflib
import hashlib
import html as entities
import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _kit as kit
from .packing import saved

#: Wrappers that one merge takes in at most, on average; a host with more is merged in more rounds.
FAN = 256
#: Bytes of hosts' wrappers (or fixed texts) that are sent to all workers; more are joined by host instead.
BROADCAST_BYTES = 32 << 20
#: A host's text is fixed from this share of its different pages on, if it has so many. Two pages alike may be near copies.
FIXED_SHARE, LEAST_PAGES = 0.9, 3
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|template|noscript|svg|iframe|textarea)\b[^>]*>.*?(?:</\1\s*>|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>|$)|[^<]+|<", re.S | re.I)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Fixed lists: elements without an end, inline elements, blocks, and what is never main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CHROME = frozenset("nav header footer aside form script style noscript template svg iframe textarea button select option head title object embed canvas audio video dialog menu".split())
MARKS = frozenset("ad ads advert adverts advertisement banner cookie cookies consent notice notices sidebar comment comments menu nav navbar navigation header footer promo sponsor sponsored related share social newsletter subscribe popup modal breadcrumb breadcrumbs pagination widget alert".split())
MAIN = ("article", "main")
#: Class words on these say how the page looks, not that its text is none.
UNMARKED = frozenset(["html", "body", *MAIN])
#: An open element of the first kind ends when one of the second kind begins.
ENDS = {"p": frozenset("p div ul ol dl table section article aside header footer nav form h1 h2 h3 h4 h5 h6 pre blockquote hr main figure address details fieldset".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}


def _marked(tag: str) -> bool:
    """Whether one of the tag's class names, its id or its role is, as a whole, a listed word."""
    if "=" not in tag:
        return False
    return any(w in MARKS for m in _MARK.findall(tag) for w in " ".join(m).lower().split())


def events(page: str):
    """(kind, name, text) of a page: open, close, text, break, void, and begin and end of inline elements; no comments.

    A marked element's name ends in `!`.
    """
    for m in _TOKEN.finditer(page):
        t = m.group()
        if t[0] != "<" or t == "<":
            yield "text", "", t
            continue
        if t.startswith("<!") or t.startswith("<?"):
            if t[:9].upper() == "<![CDATA[":
                yield "text", "", entities.escape(t[9:-3])
            continue
        if m.group(1):
            continue
        found = _NAME.match(t)
        name = found.group(1).lower() if found else ""
        if not name:
            continue
        if name in INLINE:
            yield ("end", name, "") if t[1] == "/" else ("begin", name + "!" * _marked(t), "")
        elif t[1] == "/":
            yield "close", name, ""
        elif name in VOID:
            yield "break" if name in ("br", "hr") else "void", name, ""
        else:
            named = name + ("!" if name not in UNMARKED and _marked(t) else "")
            yield "open", named, ""
            if t.endswith("/>") and name not in ENDS and "!" not in named:
                yield "close", name, ""


def texts(page: str):
    """(path of open block elements, block number, text) of every text; a path's chrome elements end in `!`.

    The path of a text in a marked inline element ends in that element.
    """
    stack: list[str] = []
    inline: list[tuple[str, int]] = []  # open inline elements from a marked one on, and how many blocks were open
    block = 0
    for kind, name, text in events(page):
        if kind == "begin":
            if inline or name[-1] == "!":
                inline.append((name, len(stack)))
            continue
        if kind == "end":
            for i in range(len(inline) - 1, -1, -1):
                if inline[i][0].rstrip("!") == name:
                    del inline[i:]
                    break
            continue
        if kind in ("text", "break"):
            block += name == "hr"
            yield (*stack, inline[0][0]) if inline else tuple(stack), block, text or " "
        elif kind == "open":
            plain = name.rstrip("!")
            while stack and plain in ENDS.get(stack[-1].rstrip("!"), ()):
                stack.pop()
            while inline and inline[-1][1] > len(stack):
                inline.pop()
            stack.append(name)
            block += 1
        elif kind == "close":
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].rstrip("!") == name:
                    del stack[i:]
                    break
            while inline and inline[-1][1] > len(stack):  # an inline element ends with its block at the latest
                inline.pop()
            block += 1


def _inline(path: tuple[str, ...]) -> bool:
    """Whether a text of that path is in a marked inline element."""
    return bool(path) and path[-1][-1] == "!" and path[-1][:-1] in INLINE


def shown(parts) -> str:
    """A block's text as it is shown: character references read, white space as one blank."""
    return " ".join(entities.unescape("".join(parts)).split())


def key(path: tuple[str, ...], text: str) -> str:
    """Stands for a text at its place among its open tags."""
    digest = hashlib.blake2b("\0".join((*path, text)).encode("utf-8", "surrogatepass"), digest_size=6).digest()
    return base64.urlsafe_b64encode(digest).decode()


def stream(page: str) -> list[str]:
    """The page's tokens: `<name`, `>name` and `#key` for the text of a block that is not blank."""
    out: list[str] = []
    blocks: dict[int, list] = {}
    for path, block, text in texts(page):
        if not _inline(path):
            blocks.setdefault(block, [path, []])[1].append(text)
    keys = {b: key(path, text) for b, (path, parts) in blocks.items() if (text := shown(parts))}
    block = 0
    for kind, name, text in events(page):
        if kind in ("text", "void", "begin", "end") or kind == "break" and name == "br":
            continue
        if block in keys:
            out.append("#" + keys[block])
        block += 1
        if kind != "break":
            out.append(("<" if kind == "open" else ">") + name)
    if block in keys:
        out.append("#" + keys[block])
    return out


def told(tokens: list[str], fixed) -> list[str]:
    """The tokens with `=key` for texts that are fixed and the slot `#` for others."""
    out: list[str] = []
    for t in tokens:
        t = t if t[0] != "#" else "=" + t[1:] if t[1:] in fixed else "#"
        if t != "#" or not out or out[-1] != "#":
            out.append(t)
    return out


def _periods(nodes: list) -> set[int]:
    """Sizes that repeated groups may have: how far equal nodes are from each other, and small ones."""
    last: dict = {}
    out = set(range(1, 13))
    for i, x in enumerate(nodes):
        if x in last:
            out.add(i - last[x])
        last[x] = i
    return out


def fold(nodes: list) -> list:
    """Groups that repeat side by side, shortest first, become repeated groups."""
    size = 0
    while size := min((x for x in _periods(nodes) if size < x <= len(nodes) // 2), default=0):
        out, i = [], 0
        while i < len(nodes):
            if i + size >= len(nodes) or nodes[i] != nodes[i + size]:
                out.append(nodes[i])
                i += 1
                continue
            group = nodes[i : i + size]
            bare = [group[0]] if size == 1 and isinstance(group[0], tuple) else group
            k = i + size
            while nodes[k : k + size] == group and len(group) == size:
                k += size
            if k > i + size and not (size == 1 and bare[0] == "#"):
                out.append(("+", tuple(group)) if not (size == 1 and isinstance(group[0], tuple) and group[0][0] == "+") else group[0])
                i = k
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    # A repeated group takes in a single copy that stands beside it.
    out = []
    for x in nodes:
        if out and isinstance(out[-1], tuple) and out[-1][0] == "+" and (x == out[-1] or (x,) == out[-1][1]):
            continue
        out.append(x)
        if isinstance(x, tuple) and x[0] == "+":
            n = len(x[1])
            while tuple(out[-1 - n : -1]) == x[1]:
                del out[-1 - n : -1]
    return out


def merge(wrapper: list, other: list) -> list:
    """One wrapper for both: what they share, and groups for what only one of them has."""
    if wrapper == other:
        return wrapper
    bare = lambda nodes: [x[1] if isinstance(x, tuple) and x[0] in "+?" else (x,) for x in nodes]
    a, b = bare(wrapper), bare(other)
    out: list = []
    for op, i, j, k, l in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():  # noqa: E741
        if op == "equal":
            for x, y in zip(wrapper[i:j], other[k:l]):
                kinds = {n[0] for n in (x, y) if isinstance(n, tuple)}
                plain = x[1] if isinstance(x, tuple) else y[1] if isinstance(y, tuple) else None
                out.append(x if not kinds else ("+", plain) if kinds == {"+"} else ("?", plain) if kinds == {"?"} else ("?", (("+", plain),)) if "+" in kinds else x)
            continue
        for part in (wrapper[i:j], other[k:l]):
            run: list = []
            for x in part:
                if isinstance(x, tuple) and x[0] == "?":
                    if run:
                        out.append(("?", tuple(run)))
                        run = []
                    out.append(x)
                else:
                    run.append(x)
            if run:
                out.append(("?", tuple(run)))
    return fold(out)


def slots(wrapper) -> tuple[set[tuple[str, ...]], set[str]]:
    """Paths of open block elements at the wrapper's texts, and the keys of its fixed texts."""
    found: set = set()
    fixed: set = set()

    def walk(nodes, stack):
        for x in nodes:
            if isinstance(x, tuple):
                inner = list(stack)
                walk(x[1], inner)
                if x[0] == "+":
                    stack[:] = inner
            elif x[0] in "#=":
                found.add(tuple(stack))
                if x[0] == "=":
                    fixed.add(x[1:])
            elif x[0] == "<":
                while stack and x[1:].rstrip("!") in ENDS.get(stack[-1].rstrip("!"), ()):
                    stack.pop()
                stack.append(x[1:])
            else:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].rstrip("!") == x[1:]:
                        del stack[i:]
                        break

    walk(wrapper, [])
    return found, fixed


def is_main(path: tuple[str, ...], main: str | None, inside: bool = False) -> bool:
    """Whether a text there is main text, given the element that holds the host's main texts (None: the body).

    inside: marks of the elements around that one do not count.
    """
    at = path.index(main) if main in path else -1
    if any(x in CHROME or x[-1] == "!" and (x[:-1] in CHROME or not inside or i > at) for i, x in enumerate(path)):
        return False
    return at >= 0 if main else True


def lies_inside(paths, main: str | None) -> bool:
    """Whether all main elements of the paths lie in marked ones, so that such marks say nothing about them."""
    return main is not None and not any(main in p and not any(x[-1] == "!" for x in p[: p.index(main)]) for p in paths)


def main_element(paths, size=None) -> str | None:
    """The element that holds the main texts: the first of MAIN with a text that is not in a menu, sidebar or the like.

    size: characters at each path; articles that hold less than half of the main element's text are teasers in it.
    """
    paths = list(paths)
    weight = {}
    for m in MAIN:
        inside = lies_inside(paths, m)
        good = [i for i, p in enumerate(paths) if m in p and is_main(p, m, inside)]
        if good:
            weight[m] = sum(size[i] for i in good) if size else 1
    if len(weight) == 2 and 2 * weight["article"] < weight["main"]:
        return "main"
    return next(iter(weight), None)


def extract(page: str, known: dict[tuple, bool] | None = None, main: str | None = None, fixed=frozenset()) -> str:
    """The page's main text: blocks in order, one to a line, without the host's fixed texts."""
    got = list(texts(page))
    filled = [(p, len(t)) for p, _, t in got if t.strip()]
    own = main_element([p for p, _ in filled], [n for _, n in filled])
    blocks: dict[int, tuple[tuple, list[str]]] = {}
    inside = lies_inside([p for p, _ in filled], own)
    for path, block, text in got:
        good = known.get(path) if known is not None and own == main else None
        if good is None:
            good = is_main(path, own, inside)
        if good:
            blocks.setdefault(block, (path, []))[1].append(text)
    lines = ((path, shown(parts)) for path, parts in blocks.values())
    return "\n".join(x for path, x in lines if x and not (fixed and key(path, x) in fixed))


def _host(url):
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def _nodes(x):
    return [(_n[0], tuple(_nodes(_n[1]))) if isinstance(_n, list) else _n for _n in x]


def learn(pages: DataFrame) -> DataFrame:
    """host and wrapper (JSON) of every host; one row per host."""

    def streams(batches):
        for part in kit.slices(batches, "html"):
            seen = {(host, " ".join(stream(page or ""))) for host, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist())}
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in seen], pa.string()) for k in (0, 1)], ["host", "tokens"])

    def keys(batches):
        for b in batches:
            for part in kit.slices([b], "tokens"):
                got = [(h, {x[1:] for x in t.split(" ") if x[:1] == "#"}) for h, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                # A page without texts says nothing; each other one counts once under the empty key.
                flat = [(h, k) for h, ks in got if ks for k in ("", *ks)]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in flat], pa.string()) for k in (0, 1)], ["host", "key"])

    def folded(batches, fixed_of):
        for part in kit.slices(batches, "tokens"):
            seen: dict[tuple, int] = {}
            for host, tokens, fixed in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), fixed_of(part)):
                k = (host, json.dumps(fold(told(tokens.split(" ") if tokens else [], frozenset(fixed.split(" ") if fixed else ())))))
                seen[k] = seen.get(k, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["host", "wrapper", "n"])

    def merged(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t["n"].to_pylist(), t["wrapper"].to_pylist()), key=lambda x: (-x[0], x[1]))
        wrapper: list | None = None
        for _, w in rows:
            nodes = _nodes(json.loads(w))
            wrapper = nodes if wrapper is None else merge(wrapper, nodes)
        return pa.table({"host": [t["host"][0].as_py()], "wrapper": [json.dumps(wrapper)], "n": pa.array([sum(x[0] for x in rows)], pa.int64())})

    schema = "host string, wrapper string, n long"
    different = saved(pages.select(_host(F.col("url")).alias("host"), "html").mapInArrow(streams, "host string, tokens string").distinct())
    counts = different.mapInArrow(keys, "host string, key string").groupBy("host", "key").agg(F.count("*").alias("n"))
    of = counts.where("key = ''").select("host", F.col("n").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    often = counts.where("key != ''").where(F.col("n") >= FIXED_SHARE * LEAST_PAGES)
    fixed = often.join(of, "host").where(F.col("n") >= FIXED_SHARE * F.col("pages")).groupBy("host").agg(F.array_join(F.sort_array(F.collect_list("key")), " ").alias("value"))
    rows, known = _with_host_value(different, fixed)
    level = saved(rows.mapInArrow(lambda b: folded(b, known), schema).groupBy("host", "wrapper").agg(F.sum("n").alias("n")))
    while (most := level.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > 1:
        salted = level.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(math.ceil(most / FAN))))
        level = saved(salted.groupBy("host", "salt").applyInArrow(merged, schema))
    return level.select("host", "wrapper")


def _with_host_value(rows: DataFrame, values: DataFrame):
    """(rows, function): the function gives the `value` of its host, or null, for each row of a batch of those rows.

    Values of BROADCAST_BYTES or less in all are sent to the workers; else they are joined as a last column.
    """
    values = saved(values.select("host", "value"))
    if (values.agg(F.sum(F.octet_length("host") + F.octet_length("value"))).first()[0] or 0) <= BROADCAST_BYTES:
        sent = rows.sparkSession.sparkContext.broadcast({r.host: r.value for r in values.toLocalIterator()})
        return rows, lambda part: [sent.value.get(h) for h in part.column(part.schema.get_field_index("host")).to_pylist()]
    return rows.join(values, "host", "left").select(*rows.columns, "value"), lambda part: part.column(part.num_columns - 1).to_pylist()


def extract_pages(pages: DataFrame, learnt: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", _host(F.col("url")).alias("host"))
    rows, wrapper_of = _with_host_value(own, learnt.select("host", F.col("wrapper").alias("value")))

    def run(batches):
        memory: dict[str, tuple] = {}
        for part in kit.slices(batches, "html"):
            out, size = [], []
            for wrapper, page in zip(wrapper_of(part), part.column(2).to_pylist()):
                got = memory.get(wrapper)
                if got is None:
                    if len(memory) > 200:
                        memory.clear()
                    paths, fixed = slots(_nodes(json.loads(wrapper))) if wrapper else (set(), set())
                    main = main_element(paths)
                    inside = lies_inside(paths, main)
                    got = memory[wrapper] = ({p: is_main(p, main, inside) for p in paths}, main, fixed)
                text = extract(page or "", *got)
                out.append(text)
                size.append(len(text))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array(size, pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = kit.table(spark, sf_dir, "pages")
    return extract_pages(pages, learn(pages))
