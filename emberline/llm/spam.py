"""Problem 9: keyword-stuffed and link-list pages.

A text's words become function-word groups and word classes. A trigram model of these classes is trained on the corpus' own prose (sentences
in the bodies of all documents). Every line of every document is scored; lines and stretches whose perplexity is abnormally high or low, by
bounds fitted on held-out prose, are candidates; an exact check then asks whether such a line is filler: terms over and over, links to many
sites, or strings of tags. A document is spam if most of its text, commit headers and diff mark-up aside, is filler.

Texts are tokenised once, into arrays of classes kept in a checkpoint; the model, its bounds and the scores are passes over these.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import spread
from ..session import checkpointed

# Frequent function words of English, French, German and Spanish by group.
GROUPS = {
    "article": "l' d' the a an le la les un une des du der die das den dem ein eine einen einem einer el los las una unos unas del al au aux",
    "preposition": "of to in on at for from with without by about into over under after before between de dans sur sous pour par avec sans im ins am an auf aus bei bis durch für gegen mit nach ohne über um unter von vor zu zum zur en con por para sobre entre hasta desde sin après avant entre chez vers",
    "pronoun": "j' m' t' s' c' qu' ma mon mes i we you they he she it this that these those our your their its nous vous ils elle on se sa son ses ce cette ces il es sie er wir ihr ich man diese dieser sich se su sus lo le esta este esto",
    "conjunction": "and or but if when where while until than then so because therefore as et ou mais que qui si quand où und oder aber wenn dass als weil y o pero cuando donde como aunque así bevor obwohl damit deshalb indem donc ainsi lorsque afin puis",
    "auxiliary": "is are was were be been has have had do does did can could will would should may might must est sont était être a ont ist sind war wird werden hat haben es son era ser ha han fue",
    "negation": "n' not no nor never nothing ne pas plus nicht kein keine ni nunca",
    "adverb": "only also just once again here there now more most few each every both all any some other such same auch nur noch so jede alle bisher nun más muy ya hay ahora todo cada je etwa nun hier dort maintenant environ chaque deux même très twice here again",
}
FUNCTION = {word: i for i, words in enumerate(GROUPS.values()) for word in words.split()}
#: A word that is none of these counts by its place in a run of such words (each place up to RUN, then by doubling lengths), or as one that
#: its line has had before: prose seldom has long runs or says a word twice in a line.
RUN, DOUBLINGS = 6, 20
CLASSES = ["<s>", "</s>", *GROUPS, *(f"word{i}" for i in range(1, RUN + 1)), *(f"word{RUN << i}" for i in range(DOUBLINGS)), "again", "number", "comma", "stop", "mark", "separator", "link", "tag"]
ID = {c: i for i, c in enumerate(CLASSES)}
SIZE, WORD, LAST_WORD = len(CLASSES), ID["word1"], ID["again"]
# Lines of commit exports, mails and diffs that are no text of their own.
HEADER = re.compile(
    r"commit [0-9a-f]{7,40}\b|(?:Author|AuthorDate|Commit|CommitDate|Date|From|Subject|Merge):|From [0-9a-f]{40}|[A-Z][a-z]+(?:-[a-z]+)*-by:|diff --git|index [0-9a-f]+\.\.|(?:new|deleted) file mode|(?:old|new) mode|"
    r"similarity index|rename (?:from|to)|--- |\+\+\+ |@@|Binary files|GIT binary|\d+ files? changed|---$|-- $|\.\.\.$|<<<<<<<|=======$|>>>>>>>"
)
# Cyrillic and Greek letters that look like Latin ones, and digits and signs put for letters.
LOOKALIKE = str.maketrans("аеорсухіјѕԁһԛԝкмнтвАЕОРСУХІЈЅКМНТВοανιρΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhqwkmhtbAEOPCYXIJSKMHTBoavipABEZHIKMNOPTYX")
INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
LEET = str.maketrans("013457@$", "oleastas")
LEETED = re.compile(r"[^\W\d_]\d|\d[^\W\d_]")
#: Words with their letters set apart.
SPACED = re.compile(r"(?<!\S)[^\W_](?: [^\W_]){2,}(?!\S)")
LINK = re.compile(r"(?:https?://|www\.)([^\s/?#\"'<>\])|]+)[^\s\"'<>\])|]*", re.I)
TAG = re.compile(r"#[^\W\d_]\w*")
HYPHENED = re.compile(r"\b[^\W\d_]+(?:-[^\W\d_]+){2,}\b")
MARKUP = re.compile(r"</?\w[^<>]*>|\[/?url\b=?|[\[\]()<>\"']")
# Words of offers and prices in four languages.
OFFER = re.compile(r"\b(?:sale|hot|new|deals?|cheap|buy|discount|free|best|offer|order|price|kaufen|günstig|rabatt|gratis|angebot|acheter|promo|soldes?|gratuite?s?|barat[oa]s?|oferta|comprar|descuento)\b|[-–]\d+ ?%|\d[.,]\d\d\b", re.I)
#: A line with one of these is code or data unless it is a link or a tag line.
CODE = re.compile(r"[_={}\[\]<>\"`\\$%^~]|\w\(|\w\.\w|\w::|\w->|^//|^#\s|^--\s|^(?:ORDER|GROUP) BY\b|^(?:LEFT )?JOIN\b|--\w|[:;]$|\w:\w|\S@\S|\d{4}-\d\d|^\w+: ")
#: Prices, shares and the label before a list make no code.
PRICE = re.compile(r"[€$£]\s?\d[\d.,]*|\d[\d.,]*\s?[€$£%]|(?<![\d.])\d+[.,]\d\d(?![\d.])")
CERTAIN, ROW = re.compile(r"[_={}\[\]<>\"`\\^~]"), re.compile(r"\w\(|\w,\w.*\w,\w")  # code whatever else is there; calls and cells of a data file
LABEL = re.compile(r"[^\W\d_]\w*(?: \w+){0,2}: (?=[^,;|]+[,;|][^,;|]+[,;|])")
TOKEN = re.compile(r"(?:[cdjlmnst]|qu|[CDJLMNST]|Qu)['’](?=\w)|#?[^\W_]+(?:['’-][^\W_]+)*|[^\w\s]+")
#: Lists: what stands between their items, and an item's most words.
BETWEEN = re.compile(r"\s[|/;·•*–-]\s|[,;|]\s*|\s::\s")
ITEM = 5
TABLE = re.compile(r"\S \| \S.* \| ")
#: Tokens of a line from which it may be a sentence, the share of function words in prose that the model learns from, and that which
#: makes a line a sentence; of n words of its own a sentence has at least n ** VARIED different ones.
SENTENCE, PROSE, SENTENCE_SHARE, VARIED = 6, 0.25, 0.3, 0.75
#: The share of held-out prose lines that lies beyond each bound of abnormal perplexity; how often a term must come to be repeated; the number of
#: sites that make a link list; the share of filler that makes a document spam.
OUTLIERS, REPEATED, SITES, MOSTLY = 0.05, 2, 3, 0.4


def plain(text: str) -> str:
    """The text in compatible forms, without invisible characters and with look-alike letters made Latin."""
    if text.isascii():
        return text
    return INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).translate(LOOKALIKE)


def content(text: str) -> list[str]:
    """The lines that are the document's own: without headers, hunk marks and the signs of added, removed and kept lines."""
    out, inside, spaced = [], False, SPACED.search(text)
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        s = line.strip()
        if not s:
            continue
        if HEADER.match(s):
            inside = inside or s.startswith(("diff --git", "@@"))
            if s.startswith("Subject:"):
                s = re.sub(r"^Subject:\s*(\[PATCH[^\]]*\])?\s*", "", s)
            else:
                continue
        elif inside and s[0] in "+-":
            s = s[1:].strip()
        if spaced and SPACED.search(s):
            s = SPACED.sub(lambda m: m[0].replace(" ", ""), s)
        if s:
            out.append(s)
    return out


class Letters(dict):
    def __missing__(self, token: str) -> str:
        t = token.translate(LEET) if any(c.isdigit() for c in token) and any(c.isalpha() for c in token) else token
        if len(self) < REMEMBER:
            self[token] = t
        return t


#: Tokens whose reading and class a worker keeps for the next time; others are worked out again.
REMEMBER = 200_000
_letters = Letters()


def words(line: str) -> list[str]:
    """Tokens of a line; digits put for letters within words are read as letters."""
    found = TOKEN.findall(line)
    return [t if t.isalpha() else _letters[t] for t in found] if LEETED.search(line) else found


def word_class(token: str) -> int:
    if token is LINK_MARK:
        return ID["link"]
    low = token.lower()
    if low in FUNCTION:
        return FUNCTION[low] + 2
    c = token[0]
    if c == "#" and len(token) > 1:
        return ID["tag"]
    if c.isdigit():
        return ID["number"]
    if c.isalpha():
        return WORD
    return ID["comma"] if c == "," else ID["stop"] if c == "." else ID["mark"] if c in "!?:;" else ID["separator"]


LINK_MARK = "\x00link"


class Memory(dict):
    def __missing__(self, token: str) -> int:
        k = word_class(token)
        if len(self) < REMEMBER:
            self[token] = k
        return k


_classes = Memory({LINK_MARK: ID["link"]})


def line_kind(line: str) -> str:
    """link, tags, words or code."""
    if "http" in line or "www." in line:
        return "link"
    if line.count("#") >= 2 and len(TAG.findall(line)) >= 2:
        return "tags"
    if line.count("-") >= 4 and len(HYPHENED.findall(line)) >= 2 and "," in line:
        return "tags"
    table = " | " in line and TABLE.search(line)
    if CERTAIN.search(line):
        return "words" if table else "code"
    if table or not CODE.search(line):
        return "words"
    if ROW.search(line):
        return "code"
    rest = PRICE.sub("0", line) if any(map(str.isdigit, line)) else line
    if ": " in rest:
        rest = LABEL.sub("", rest, count=1) if LABEL.match(rest) else rest
    if rest.count(" ") >= SENTENCE - 1:  # a heading, not the start of a block
        rest = rest.rstrip(": ")
    return "code" if CODE.search(rest) else "words"


def line_tokens(line: str, kind: str) -> list[str]:
    if kind == "link":
        rest = MARKUP.sub(" ", LINK.sub(" \x01 ", line))
        return [LINK_MARK if t == "\x01" else t for t in re.split(r"(\x01)", rest) for t in ([t] if t == "\x01" else words(t))]
    if kind == "tags":
        return TAG.findall(line) or ["#" + t for t in HYPHENED.findall(line)]
    return words(line) if kind == "words" else TOKEN.findall(line)


# -- lines of many texts at once: flat arrays, one element per token or line


def classed(tokens: list[str], line: np.ndarray) -> np.ndarray:
    """Classes of the tokens of many lines (``line``: the number of each token's line, sorted); words get their place in a run of words, which
    function words end and signs don't, or "again" if their line has had them before."""
    k = np.fromiter(map(_classes.__getitem__, tokens), dtype="int64", count=len(tokens))
    word = k == WORD
    before = np.cumsum(word) - word  # words before each token
    restart = k < WORD
    restart[:1] = True
    restart[1:] |= line[1:] != line[:-1]
    run = before - np.maximum.accumulate(np.where(restart, before, 0))
    code = pd.factorize(np.array(tokens, dtype=object)[word])[0]
    again = pd.Series(line[word] * (code.max(initial=0) + 1) + code).duplicated().to_numpy()
    r = run[word]
    k[word] = np.where(again, ID["again"], WORD + np.where(r < RUN, r, RUN + np.minimum(np.log2(np.maximum(r, RUN) / RUN).astype("int64"), DOUBLINGS - 1)))
    return k


def distinct(line: np.ndarray, low: np.ndarray, lines: int) -> np.ndarray:
    """Number of different tokens of every line."""
    code = pd.factorize(low)[0]
    pairs = np.unique(line * (code.max(initial=0) + 1) + code)
    return np.bincount(pairs // (code.max(initial=0) + 1), minlength=lines)


def varied(count: np.ndarray, different: np.ndarray) -> np.ndarray:
    """Whether so many words are as different as in prose: their number grows as a power of the length."""
    return different >= count.astype(float) ** VARIED


#: Kinds of lines as they are kept: sentences that say something, and the other lines.
CODE_LINE, WORDS, LINKS, TAGS, SAYING, STUFFED = range(6)
KINDS = {"code": CODE_LINE, "words": WORDS, "link": LINKS, "tags": TAGS}


class Lines:
    """Lines of many texts as flat arrays: ``text`` (number of the text), ``kind``, ``chars``, ``size`` (tokens), and per token ``line, ids``."""

    def __init__(self, text, kind, chars, size, ids):
        self.text, self.kind, self.chars, self.size, self.ids = text, kind, chars, size, ids
        self.line = np.repeat(np.arange(len(size)), size)

    def share(self) -> np.ndarray:
        """Share of function words among every line's words."""
        n = len(self.size)
        own = np.bincount(self.line, (self.ids >= 2) & (self.ids <= LAST_WORD), minlength=n)
        return np.divide(np.bincount(self.line, (self.ids >= 2) & (self.ids < WORD), minlength=n), own, out=np.zeros(n), where=own > 0)

    def trigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Class trigrams of all lines with an end mark after each, as numbers, and the line of each."""
        n = len(self.size)
        at = np.concatenate([[0], np.cumsum(self.size + 1)])
        full = np.ones(at[-1], dtype="int64")  # the end mark
        inside = np.ones(at[-1], bool)
        inside[at[1:] - 1] = False
        full[inside] = self.ids
        line = np.repeat(np.arange(n), self.size + 1)
        pos = np.arange(at[-1]) - at[line]
        one = np.where(pos >= 1, np.concatenate([[0], full[:-1]]) if len(full) else full, 0)
        two = np.where(pos >= 2, np.concatenate([[0, 0], full[:-2]])[: len(full)] if len(full) else full, 0)
        return (two * SIZE + one) * SIZE + full, line

    def prose(self) -> np.ndarray:
        """Lines that the model learns from: words with function words among them."""
        return np.isin(self.kind, (WORDS, SAYING, STUFFED)) & (self.size >= SENTENCE) & (self.share() >= PROSE)


def read(texts: list[str]) -> tuple[Lines, list[str]]:
    """The own lines of the texts, and their wording."""
    lines, text, kinds, size, tokens = [], [], [], [], []
    for i, t in enumerate(texts):
        for s in content(plain(t)):
            kind = line_kind(s)
            own = line_tokens(s, kind)
            lines.append(s)
            text.append(i)
            kinds.append(KINDS[kind])
            size.append(len(own))
            tokens += own
    size, kind = np.array(size, dtype="int64"), np.array(kinds, dtype="uint8")
    line = np.repeat(np.arange(len(size)), size)
    d = Lines(np.array(text, dtype="int64"), kind, np.fromiter(map(len, lines), "int64", len(lines)), size, classed(tokens, line) if tokens else np.zeros(0, "int64"))
    # sentences: enough function words, and enough different ones; they say something if their own words differ as prose's do
    maybe = (kind == WORDS) & (size >= SENTENCE) & (d.share() >= SENTENCE_SHARE)
    if maybe.any():
        n = len(size)
        low = np.array([t.lower() for t, m in zip(tokens, maybe[line]) if m], dtype=object)
        at, ids = line[maybe[line]], d.ids[maybe[line]]
        of, own = (ids >= 2) & (ids < WORD), (ids >= WORD) & (ids <= LAST_WORD)
        maybe &= distinct(at[of], low[of], n) >= np.maximum(2, np.minimum(6, 0.15 * size))
        says = varied(np.bincount(at[own], minlength=n), distinct(at[own], low[own], n))
        d.kind = np.where(maybe, np.where(says, SAYING, STUFFED), kind).astype("uint8")
    return d, lines


def surprisal(counts: np.ndarray) -> np.ndarray:
    """Negative log probabilities of an interpolated trigram model, by trigram number."""
    c = counts.reshape(SIZE, SIZE, SIZE).astype(float)
    two = c.sum(axis=0)
    one = two.sum(axis=0)
    p1 = (one + 1) / (one.sum() + SIZE)
    p2 = (two + 2 * p1) / (two.sum(axis=1, keepdims=True) + 2)
    p3 = (c + 2 * p2[None]) / (c.sum(axis=2, keepdims=True) + 2)
    return -np.log(p3).ravel()


class ProseModel:
    """Trigram model of prose from the counts of two halves of it. Mean and deviation of the surprisal per token are those of each half under the
    other's model; ``bounds`` are the mean surprisals of a line, in standard errors, beyond which it is abnormally low or high."""

    def __init__(self, halves: np.ndarray, bounds: tuple[float, float] = (-2.0, 2.0)):
        self.surprise = surprisal(halves.sum(axis=0))
        self.other = [surprisal(halves[1 - h]) for h in (0, 1)]
        seen = halves.astype(float) if halves.any(axis=1).all() else np.stack([halves.sum(axis=0)] * 2).astype(float)
        tables = self.other if halves.any(axis=1).all() else [self.surprise] * 2
        n = max(1.0, seen.sum())
        self.mean = float(sum((s * x).sum() for s, x in zip(seen, tables)) / n)
        self.deviation = float(np.sqrt(max(1e-9, sum((s * (x - self.mean) ** 2).sum() for s, x in zip(seen, tables)) / n)))
        self.bounds = bounds

    def over(self, d: Lines, half: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Every line's surprisal over the mean (with ``half`` under the model of the other half), and its length with the end mark."""
        k, line = d.trigrams()
        n = d.size + 1
        return np.bincount(line, (self.surprise if half is None else self.other[half])[k], minlength=len(n)) - n * self.mean, n

    def standard(self, over: np.ndarray, n: np.ndarray) -> np.ndarray:
        return over / (self.deviation * np.sqrt(n))

    def outside(self, z: np.ndarray) -> np.ndarray:
        return (z <= self.bounds[0]) | (z >= self.bounds[1])


def deviations(over: np.ndarray, n: np.ndarray, group: np.ndarray, groups: int, model: ProseModel) -> tuple[np.ndarray, np.ndarray]:
    """Per group of lines the mean surprisal over prose's in standard errors, and the excess of the squared deviations in theirs: lines above and
    lines below the mean must not cancel out."""
    variance = model.deviation**2
    total, length, count = (np.bincount(group, w, minlength=groups) for w in (over, n, np.ones(len(n))))
    squares = np.bincount(group, over * over / n / variance, minlength=groups)
    return total / np.sqrt(np.maximum(length, 1) * variance), (squares - count) / np.sqrt(2 * np.maximum(count, 1))


def abnormal(d: Lines, over: np.ndarray, n: np.ndarray, model: ProseModel) -> np.ndarray:
    """The lines that are abnormal for prose: by themselves, or as part of a stretch of lines that are no sentences."""
    one = d.kind == SAYING
    change = np.ones(len(one), bool)
    change[1:] = (one[1:] != one[:-1]) | (d.text[1:] != d.text[:-1])
    stretch = np.cumsum(change) - 1
    z, squares = deviations(over, n, stretch, int(stretch[-1]) + 1 if len(stretch) else 0, model)
    return model.outside(model.standard(over, n)) | (~one & (model.outside(z) | (squares >= model.bounds[1]))[stretch])


def site(host: str) -> str:
    return ".".join(host.lower().split(":")[0].rstrip(".,").split(".")[-2:])


def check(lines: list[tuple[str, int]]) -> tuple[list[bool], int]:
    """Which of a text's abnormal lines (wording, kind) are filler, and how many sites they link: links to SITES sites or more, strings of tags, lines
    most of whose words come again, and lists with words that do."""
    sites: set[str] = set()
    pairs: Counter[tuple[str, str]] = Counter()
    single: Counter[str] = Counter()
    prepared = []
    for s, kind in lines:
        if kind == LINKS:
            sites.update(site(h) for h in LINK.findall(s))
        tokens = line_tokens(s, "link" if kind == LINKS else "tags" if kind == TAGS else "words")
        ks = [_classes[t] for t in tokens]
        low = [t.lower() for t, k in zip(tokens, ks) if k == WORD]
        pairs.update(zip(low, low[1:]))
        single.update(low)
        prepared.append((s, kind, low, sum(k < WORD for k in ks)))
    out = []
    for s, kind, low, functions in prepared:
        if kind == LINKS:
            found = len(sites) >= SITES
        elif kind == TAGS:
            found = True
        else:
            again = sum(pairs[p] >= REPEATED for p in zip(low, low[1:]))
            alone = sum(single[w] >= REPEATED for w in low)
            found = bool(low) and (alone >= 0.7 * len(low) or (alone >= 0.4 * len(low) and again >= 0.2 * len(low)))
            if not found and low:
                items = len(BETWEEN.findall(s)) + 1
                if items >= 3 and len(low) <= ITEM * items and functions < 0.1 * (functions + len(low)):
                    found = alone >= (0.2 if OFFER.search(s) and TABLE.search(s) else 0.5) * len(low)
        out.append(found)
    return out, len(sites)


def judge(d: Lines, wording: list[str | None], texts: int, model: ProseModel, least: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text the share of filler, how abnormal the filler's surprisal is for prose, and the number of sites linked.

    Every line is scored; only abnormal ones are checked for filler. Sentences that say something and code are none. Texts whose abnormal
    lines don't make up ``least`` of them aren't checked further: their filler is less than that.
    """
    share, dev, sites = np.zeros(texts), np.zeros(texts), np.zeros(texts, dtype="int64")
    if not len(d.size):
        return share, dev, sites
    over, n = model.over(d)
    total = np.bincount(d.text, d.chars, minlength=texts)
    candidate = abnormal(d, over, n, model) & (d.kind != CODE_LINE) & (d.kind != SAYING) & (d.size > 0)
    worth = np.bincount(d.text, d.chars * candidate, minlength=texts) >= np.maximum(1, least * total)
    at = np.flatnonzero(candidate & worth[d.text])
    for own in np.split(at, np.flatnonzero(np.diff(d.text[at])) + 1) if len(at) else []:
        found, k = check([(wording[i], d.kind[i]) for i in own])
        i, hit = d.text[own[0]], own[np.array(found)]
        sites[i] = k
        if len(hit):
            share[i] = d.chars[hit].sum() / total[i]
            dev[i] = max(abs(x[0]) for x in deviations(over[hit], n[hit], np.zeros(len(hit), dtype="int64"), 1, model))
    return share, dev, sites


# -- on the cluster

#: Characters of text that are read or judged at a time: the size of the flat arrays.
BLOCK = 2_000_000
READ = "doc_id bigint, half int, kind binary, chars binary, size binary, ids binary, wording binary"


def _blocks(sizes: list[int]) -> Iterator[slice]:
    a = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= BLOCK or i == len(sizes) - 1:
            yield slice(a, i + 1)
            a, total = i + 1, 0


def lines_of(documents: DataFrame) -> DataFrame:
    """Every document's own lines as arrays, once for all passes over them: kind, characters, number of tokens, classes of the tokens, and the wording
    of the lines that may be filler. ``half`` is by the hash of the id."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = [b"" if x is None else bytes(x) for x in pdf.text]
            for part in _blocks([len(x) for x in raw]):
                d, wording = read([x.decode("utf-8", "replace") for x in raw[part]])
                count = part.stop - part.start
                a = np.searchsorted(d.text, np.arange(count + 1))
                t = np.concatenate([[0], np.cumsum(d.size)])[a]
                ids, size, chars = d.ids.astype("uint8"), d.size.astype("<i4"), d.chars.astype("<i4")
                kept = [s if k not in (CODE_LINE, SAYING) else None for s, k in zip(wording, d.kind)]
                out = [(d.kind[i:j].tobytes(), chars[i:j].tobytes(), size[i:j].tobytes(), ids[p:q].tobytes(), "\n".join(s for s in kept[i:j] if s is not None).encode("utf-8", "replace")) for i, j, p, q in zip(a, a[1:], t, t[1:])]
                yield pd.DataFrame([(*key, *row) for key, row in zip(zip(pdf.doc_id[part], pdf.half[part]), out)], columns=[c.split()[0] for c in READ.split(", ")])

    binary = documents.filter(F.col("doc_id").isNotNull()).select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half"), F.col("text").cast("binary").alias("text"))
    return spread(binary, "doc_id").mapInPandas(encode, READ)


def _joined(pdf: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, Lines, list[str | None]]]:
    """Blocks of the rows of ``lines_of``, their lines, and the wording of those that may be filler."""
    for part in _blocks([len(x) for x in pdf.ids]):
        own = pdf.iloc[part]
        whole = lambda c, t, own=own: np.frombuffer(b"".join(map(bytes, own[c])), t)
        kind = whole("kind", "uint8")
        text = np.repeat(np.arange(len(own)), [len(x) for x in own.kind])
        d = Lines(text, kind, whole("chars", "<i4").astype("int64"), whole("size", "<i4").astype("int64"), whole("ids", "uint8").astype("int64"))
        wording: list[str | None] = [None] * len(kind)
        kept = np.flatnonzero((kind != CODE_LINE) & (kind != SAYING))
        some = np.bincount(text[kept], minlength=len(own))
        for i, s in zip(kept, (s for w, n in zip(own.wording, some) if n for s in bytes(w).decode("utf-8").split("\n"))):
            wording[i] = s
        yield own, d, wording


def train(lines: DataFrame) -> ProseModel:
    """The model of the prose of all documents: two tables of SIZE ** 3 counts and two histograms of line scores, whatever the corpus."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros((2, SIZE**3), dtype="int64")
        for pdf in batches:
            for own, d, _ in _joined(pdf):
                k, line = d.trigrams()
                use = d.prose()[line]
                np.add.at(table, (own.half.to_numpy()[d.text[line[use]]], k[use]), 1)
        half, k = np.nonzero(table)
        yield pd.DataFrame({"half": half, "k": k, "n": table[half, k]})

    halves = np.zeros((2, SIZE**3), dtype="int64")
    for half, k, n in lines.mapInPandas(count, "half int, k bigint, n bigint").groupBy("half", "k").agg(F.sum("n")).collect():
        halves[half, k] = n
    model = ProseModel(halves)
    if not halves.any(axis=1).all():
        return model
    shared = lines.sparkSession.sparkContext.broadcast(model)

    def spread_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(2 * STEPS + 1, dtype="int64")
        for pdf in batches:
            for own, d, _ in _joined(pdf):
                half, prose = own.half.to_numpy()[d.text], d.prose()
                for h in (0, 1):
                    z = shared.value.standard(*shared.value.over(d, h))[prose & (half == h)]
                    np.add.at(table, np.clip(np.round(z * PER_ERROR), -STEPS, STEPS).astype("int64") + STEPS, 1)
        at = np.flatnonzero(table)
        yield pd.DataFrame({"k": at - STEPS, "n": table[at]})

    found = sorted(lines.mapInPandas(spread_of, "k bigint, n bigint").groupBy("k").agg(F.sum("n")).collect())
    share = np.cumsum([n for _, n in found]) / max(1, sum(n for _, n in found))
    k = np.array([k for k, _ in found]) / PER_ERROR
    low, high = (float(k[np.searchsorted(share, q)]) for q in (OUTLIERS, 1 - OUTLIERS))
    return ProseModel(halves, (min(low, -1.0), max(high, 1.0)))


#: Resolution of the histogram of line scores, per standard error, and its reach.
PER_ERROR, STEPS = 20, 400


def scored(documents: DataFrame, least: float = 0.0) -> DataFrame:
    """``doc_id, filler, deviation, sites`` of every document: see ``judge``. Null and empty texts have no filler.

    ``documents`` needs ``doc_id`` and ``text``; other columns are ignored. Rows without id are left out, repeated rows come out repeatedly, and an
    empty table gives no rows. Bytes that aren't UTF-8 count as replacement characters. With ``least`` documents that can't reach that share of
    filler have 0.
    """
    lines = checkpointed(lines_of(documents))
    model = documents.sparkSession.sparkContext.broadcast(train(lines))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for own, d, wording in _joined(pdf):
                share, dev, sites = judge(d, wording, len(own), model.value, least)
                yield pd.DataFrame({"doc_id": own.doc_id.to_numpy(), "filler": share, "deviation": dev, "sites": sites})

    return lines.mapInPandas(score, "doc_id bigint, filler double, deviation double, sites int")


def spam_pages(documents: DataFrame, mostly: float = MOSTLY) -> DataFrame:
    """``doc_id`` and the scores of the documents most of whose text is filler that is abnormal for prose."""
    return scored(documents, mostly).filter(F.col("filler") >= mostly)
