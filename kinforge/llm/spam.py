"""Pages of repeated keywords, link lists and product or tag lists instead of sentences.

For each page's own content (without menu, cookie notice and footer) a suffix automaton over its words is built; from it
comes, for every word, the longest run of words ending there that occurs again, and so the characters that repeated maximal
runs cover. The content is also divided into segments, and each is judged by its clause structure: enough different words, closed
like a sentence, no list separators or addresses. A page is spam if most of its own content isn't in clauses and forms a list of
some length; a segment that repeated runs cover mostly counts as no clause, however it is punctuated, and the share of the whole
content that repeated runs cover counts beside the missing clauses. Pages are judged
one by one in Arrow batches: there is no shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import compress

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of page menus (letters a-z only, so that wrongly decoded text is met too).
MENU = frozenset(
    "home contact about aboutus news events jobs shop blog help search archive gallery members delivery signin login register openinghours sitemap terms privacy imprint faq services products "
    "startseite kontakt beruns suche hilfe laden archiv anmelden ffnungszeiten termine aktuelles impressum datenschutz "
    "accueil propos boutique connexion aide archives agenda recherche actualits mentionslgales "
    "inicio contacto quinessomos tienda entrar ayuda archivo noticias buscar avisolegal".split()
)
COOKIE = re.compile(r"cookie|files on your device|kleine dateien|petits fichiers|t(?:é|Ã©|e)moins|archivos peque", re.I)
FOOTER = re.compile(r"^\W*(?:Â)?(?:©|\(c\)|copyright\b)", re.I)
MORE = re.compile(r"^[^\W\d]+(?: [^\W\d]+){0,2}: [^\W\d]+(?:, [^\W\d]+){0,7}$")
WORD = re.compile(r"[^\W_]+")
ITEMS = re.compile(r"\s*[|·>•»]\s*|\s{2,}|\t")
BREAK = re.compile(r"(?<=[.!?…])[\"'”»)\]]*\s+")
LISTED = re.compile(r"[★☆|•»]|>>|https?://|www\.|::|#\w|[^\W\d]: \d+$")

SEPARATOR = re.compile(r"[★☆|•»]|>>|[,;]|https?://")

MIN_WORDS = 5
#: Words from which a repeated run is a sentence, and from which text without punctuation can be one.
LONG_RUN, RUN_ON = 8, 12
#: Most words of a first line that may be the clipped start of what follows; times from which a repeated sentence is a keyword list too.
FIRST_WORDS, MANY = 40, 6
MIN_VARIETY = 0.62
MIN_LISTED_CHARS = 150
MIN_ENTRIES = 8
#: Share of a page's own characters from which it is spam: those outside clauses, plus COVERED times those that repeated runs cover
#: beyond the share USUAL that long texts of sentences reach too.
SHARE, COVERED, USUAL = 0.5, 0.2, 0.9


def longest_repeats(symbols: list[int]) -> list[int]:
    """For each position the length of the longest run ending there that occurs at least twice, by a suffix automaton."""
    step: list[dict] = [{}]
    link, length, prefixes, last = [-1], [0], [], 0
    for c in symbols:
        cur = len(length)
        length.append(length[last] + 1)
        step.append({})
        link.append(0)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p != -1:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                step.append(step[q].copy())
                link.append(link[q])
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
        prefixes.append(cur)
    inner = set(link)
    return [length[s] if s in inner else length[link[s]] for s in prefixes]


def _menu_item(item: str) -> bool:
    return re.sub(r"[^a-z]", "", item.lower()) in MENU


def own_lines(text: str) -> list[str]:
    """The lines of a page's own content."""
    lines = [x for x in (line.strip() for line in text.splitlines()) if x]
    start = 0
    while start < len(lines):
        line = lines[start]
        items = [i for i in ITEMS.split(line) if i]
        menu = sum(map(_menu_item, items)) >= max(1, (len(items) + 1) // 2)
        if not (menu or (start < 3 and COOKIE.search(line))):
            break
        start += 1
    lines = lines[start:]
    more = 0  # one list of further topics at the end belongs to the site, several are the page's own
    while lines:
        if len(lines) > 1 and more == 0 and MORE.match(lines[-1]) and "," in lines[-1] and len(lines[-1]) < 160:
            more += 1
        elif not (FOOTER.match(lines[-1]) or COOKIE.search(lines[-1]) and len(lines[-1]) < 160):
            break
        lines = lines[:-1]
    return _unwrapped(lines)


def _unwrapped(lines: list[str]) -> list[str]:
    """Lines of a sentence that was broken over a few lines are joined: each goes on in lower case or after a comma, and
    the last is closed."""
    out, i = [], 0
    while i < len(lines):
        end = i
        while end + 1 < len(lines) and end < i + 8 and lines[end][-1] not in ".!?…" and (lines[end + 1][0].islower() or lines[end][-1] == ",") and not LISTED.search(lines[end]):
            end += 1
        if end > i and lines[end][-1] in ".!?…":
            out.append(" ".join(lines[i : end + 1]))
            i = end + 1
        else:
            out.append(lines[i])
            i += 1
    return out


def judge(text: str | None) -> tuple[int, int, int, int, bool]:
    """(own characters, characters in clauses, characters covered by repeated runs of two words or more, list entries, spam)."""
    lines = own_lines(text or "")
    ids: dict[str, int] = {}
    symbols: list[int] = []
    sizes: list[int] = []
    parts = []  # segment, first word, last word
    for n, line in enumerate(lines):
        for s in BREAK.split(line):
            found = WORD.findall(s)
            if not found:
                continue
            first = len(symbols)
            for w in found:
                symbols.append(ids.setdefault(w.lower(), len(ids)))
                sizes.append(len(w))
            parts.append((s, first, len(symbols), n))
    repeats = longest_repeats(symbols)
    covered = [False] * len(symbols)
    reach = len(symbols)
    for i in range(len(symbols) - 1, -1, -1):  # a run of two words or more that occurs again covers all its words
        if repeats[i] >= 2:
            reach = min(reach, i - repeats[i] + 1)
        covered[i] = reach <= i
        if reach == i:
            reach = len(symbols)
    own = clause = entries = 0
    runs: Counter = Counter()
    if repeats and max(repeats) >= LONG_RUN:
        runs.update(tuple(symbols[i : i + LONG_RUN]) for i in range(len(symbols) - LONG_RUN + 1))
    for s, a, b, n in parts:
        size, count = sum(sizes[a:b]), b - a
        again = sum(compress(sizes[a:b], covered[a:b]))
        # short runs that come again and again are keywords, whatever the punctuation; so is a whole sentence only if it comes often
        often = max((runs[tuple(symbols[i : i + LONG_RUN])] for i in range(a, b - LONG_RUN + 1)), default=0) if runs else 0
        stuffed = again >= 0.9 * size and max(repeats[a:b]) < LONG_RUN or again >= 0.7 * size and often >= MANY
        varied = len(set(symbols[a:b])) >= MIN_VARIETY * min(count, 40)
        listed = LISTED.search(s)
        closed = s[-1] in ".!?…\"'”»)"
        own += size
        if count >= MIN_WORDS and closed and varied and not listed and not stuffed:
            clause += size
        elif MIN_WORDS <= count <= FIRST_WORDS and n == 0 < parts[-1][3] and not closed and not listed:
            own -= size  # a short first line that breaks off is the start of a text that follows
        elif count >= RUN_ON and not listed and again < 0.5 * size and sum(z <= 3 for z in sizes[a:b]) >= 0.2 * count:
            clause += size  # sentences without punctuation: small words in between, little repeated
        elif 1 < count < MIN_WORDS and closed and len(parts) < 6:
            clause += size
        else:
            entries += max(len(SEPARATOR.findall(s)) + 1, count // 4)
    again = sum(compress(sizes, covered))
    # what isn't in clauses and what repeated runs cover beyond the usual weigh together
    weight = own - clause + COVERED * max(0.0, again - USUAL * own)
    spam = own > 0 and own - clause >= MIN_LISTED_CHARS and weight >= SHARE * own and entries >= MIN_ENTRIES
    return own, clause, again, entries, spam


def judged(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, own_chars, clause_chars, repeated_chars, entries, spam) for each row; NULL and empty texts are no spam. Rows with
    NULL id are left out. Texts are read whole."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [judge(t) for t in pdf["text"]]
            out = pd.DataFrame(rows, columns=["own_chars", "clause_chars", "repeated_chars", "entries", "spam"])
            out.insert(0, "id", pdf["id"].to_numpy())
            yield out

    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text"))
    return rows.mapInPandas(each, "id bigint, own_chars bigint, clause_chars bigint, repeated_chars bigint, entries bigint, spam boolean")


def p9_pages(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


def p9_found(spark, sf_dir: str) -> DataFrame:
    return p9_pages(spark, sf_dir).where("spam").select("doc_id").distinct()
