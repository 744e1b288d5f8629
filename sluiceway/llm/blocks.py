"""What a text block (a line of a page) is, judged from the line alone.

Plain functions over strings, used inside Arrow-batched passes. A line is judged by its density of
function words, its length, its end, its bullets, figures and marks, at any length alike; no list of
phrases is asked, and nothing here looks at other pages.
"""

from __future__ import annotations

import re

#: Kinds of a line. ``BOILER`` is never given here: that takes other pages (see ``support``).
BLANK, PROSE, SHORT, BOILER, ITEM, TABLE, CODE, LOG, JUNK = range(9)

# Frequent function words of ten languages.
STOP_WORDS = {
    "en": "the of and to a in that is was for it as with be on by at this have has had from not are were but which one who would her his she he so only what if you than when there these an no my could they we us neither nor then some any will about into been their its your i me how why all more never",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine einen einer eines als auch es an er hat aus bei nach wie am um sie aber weil wird war sind noch zum zur über unser mein vor seit ohne jeden viel wohnt",
    "fr": "le la les de des un une et en du que qui dans il elle est pour pas par sur ne se ce au aux avec plus son sa ses mais car ou à comme nous vous être été sont depuis sans trop puis parce chez notre mon c'est malgré jour",
    "es": "el la los las de del un una y en que se por con no para es su al lo como más pero sus le ya o este porque cuando muy sin sobre también me hasta hay donde desde todo nos fue quien aunque luego mi nuestra dice",
    "pt": "o a os as de do da dos das um uma e em no na que se por com não para é seu sua ao mais mas como foi ele ela ou ser quando muito já também só pelo pela até isso porque nosso meu",
    "it": "il lo la i gli le di del della dei un una e in che si per con non è al da su come più ma anche sono nel nella ha questo o dal alla perché poi quando nostro mio senza ogni",
    "nl": "de het een en van in dat die is te op zijn met voor niet aan er om ook als bij maar of uit door naar dan nog wordt was over heeft zij hij omdat onze mijn zonder sinds na elke",
    "sv": "och i att det som en ett på är av för med den till inte de om har han hon men sig från vid så eller när än under också efter utan vår min eftersom varje sedan",
    "pl": "i w na z się nie do to że jest o jak po od za dla przez ale co czy tak był była są jego jej lub oraz który która gdy bo nasz mój bez przed każdego",
    "ru": "и в не на что я с он она как это по но из у за от же к для бы о так его её то был была мы вы они который потому уже когда после без мой наш под каждый",
}
STOP = frozenset(w for ws in STOP_WORDS.values() for w in ws.split())

_BULLET = re.compile(r"^(?:[•»*▪‣◦·–—>-]+\s+|#+\s+|\(?\d{1,3}[.)]\s+)+")
_TAIL = " .!…>»"
_END = re.compile(r"[.!?…。][\"'”’»)\]]*(?:\s*(?:lol|:\)|!!+))?$")
_STOPS, _CLOSERS = frozenset(".!?…。"), frozenset("\"'”’»)]lL")
_LOG = re.compile(r"^\[?\(?(?:\d{4}[-/.]\d\d[-/.]\d\d|\d\d[-/.]\d\d(?:[-/.]\d{2,4})?)[ T,]+\d\d:\d\d|\brc=-?\d|\b0x[0-9a-f]{4,}\b|^(?:DEBUG|INFO|WARN|ERROR|FATAL|TRACE)\b|\b(?:GET|POST|HEAD) /\S* HTTP|^\s*at [\w.$]+\([\w.]+:\d+\)")
_CODE = re.compile(
    r"[{};]\s*$|^\s*(?:var|let|const|def|class|import|from|return|function|public|private|static|#include|package|using|elif|else:|try:|except|while|for|if)\b.*[({:;=]|^\s*[\w.\[\]]+ ?(?:[-+*/]|:)?= ?[^=\s].*[\])'\";0-9]\s*$|^\s*[\w.]+\([^)]*\);?\s*$|=>|::|&&|</?\w+[^<>]*>|^\s*(?://|/\*|\*/|#!)|\bfunction\s*\("
)
_CELL = re.compile(r"^[-+(]?[$€£]?\d[\d.,:/]*\)?[%°a-zA-Z€$]{0,3}$|^(?:n/?a|-|–|—|\?|null|nan|yes|no|x|✓)$", re.I)
# Cells without a figure.
_WORD_CELLS = frozenset("n/a na - ? null nan yes no x".split())
_LETTERS = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPLIT = re.compile(r"\s*[|;\t]+\s*|\s{2,}")
_MOJI = re.compile(r"[ÐÑÃÂâ][\x80-\xbf\u2018-\u203a€™šžŸ„…†‡ˆ‰Šƒ¡-¿ÃÑÐ]|\ufffd|ï¿½")
_LONG = re.compile(r"\S{40,}")
_SOUP = re.compile(r"[^\w\s.,'’“”\"!?-]")


def ended(s: str) -> bool:
    """Whether a stripped line ends as a sentence does. Most lines tell by their last character."""
    last = s[-1:]
    return last in _STOPS if last not in _CLOSERS else _END.search(s[-40:]) is not None


def _bare(s: str) -> str:
    """A squeezed line without bullet and closing marks."""
    if not s[:1].isalpha():
        s = _BULLET.sub("", s)
    if s[-1:] in _TAIL:
        s = s.rstrip(_TAIL)
    return s


def bare(line: str) -> str:
    """A line without bullet, closing marks and doubled spaces."""
    return _bare(" ".join(line.split()))


WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


_DIGIT = re.compile(r"\d")
_CODE_MARK = re.compile(r"[{};(:=<>&/#*]")


def kind(line: str, parts: list[str] | None = None) -> tuple[int, int, int]:
    """Kind of a line, its number of words, and how many of them are function words.

    ``SHORT`` is undecided: a few words without the end of a sentence, as a headline, a link or an item has.
    Blanks around a line make no difference. ``parts`` is the line in lower case, split at blanks, if known.
    """
    s = line.strip()
    if not s:
        return BLANK, 0, 0
    ws = s.lower().split() if parts is None else parts
    k = len(ws)
    stops = sum(map(STOP.__contains__, ws))
    return _judge(s, len(s), k, stops / k, ws), k, stops


def _judge(s: str, n: int, k: int, share: float, ws: list[str]) -> int:
    if share < 0.3:
        plain = s.isascii()
        letters = n - len(s.encode().translate(None, _LETTERS)) if plain else sum(map(str.isalpha, s))
        bad = 0 if plain else len(_MOJI.findall(s))
        if bad * 25 > n and bad > 1:
            return JUNK
        if letters * 2 < n and len(_SOUP.findall(s)) * 3 > n:
            return JUNK
        figures = _DIGIT.search(s) is not None
        if (figures or s[:4].isupper()) and (_LOG.search if "rc=" in s or "0x" in s or " /" in s else _LOG.match)(s):  # the others stand at the start
            return LOG
        if share < 0.25 and _CODE_MARK.search(s) and _CODE.search(s):
            return CODE
        long = sum(map(len, _LONG.findall(s))) if n >= 40 and max(map(len, ws)) >= 40 else 0
        if long * 2 > n and not s.startswith(("http://", "https://", "www.", "#")):
            return JUNK if " " not in s or long * 4 > n * 3 else ITEM
        tokens = s.replace("|", " ").replace(";", " ").split() if not plain else s.lower().replace("|", " ").replace(";", " ").split() if "|" in s or ";" in s else ws
        num = sum(map(_WORD_CELLS.__contains__, tokens)) if plain and not figures else len(tokens) - list(map(_CELL.match, tokens)).count(None)
        if num * 3 >= len(tokens) and num >= 2 and len(tokens) >= 3:
            return TABLE
        if letters * 3 < n and k >= 8:
            return JUNK
        cells = _SPLIT.split(s) if "|" in s or ";" in s or "\t" in s or "  " in s else ()
        if len(cells) >= 3 and all(len(c) < 40 for c in cells) and not _END.search(s[-40:]):
            return TABLE
    end = ended(s)
    if share >= 0.2 and (k >= 12 or end):
        return PROSE
    if end and k >= 25 and share >= 0.1:
        return PROSE
    if n > 200 and share >= 0.15:
        return PROSE
    if not s[0].isalnum() and _BULLET.match(s) or s[0].isdigit() and _BULLET.match(s):
        return ITEM
    if share < 0.1 and n > 100:
        return ITEM
    return SHORT
