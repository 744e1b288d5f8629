"""What a page is, from its lines: facts that merge, keys of its lines, residue of templates.

Plain functions; the operators in this subpackage run them inside Arrow-batched passes. A text is read
through one path: it is cut into chunks, each chunk gives a partial state (the facts of its closed
lines and its open first and last piece), states merge associatively, and a finished state is a
``Page``. A text within one chunk is a tree with one leaf.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from xxhash import xxh3_64_intdigest

from . import blocks as B
from .automaton import repeat_marks

#: Marks of a line.
ENDED, OPEN, BLANKS, ITEMS, NOTICE, FILLER, HINTED = 1, 2, 4, 8, 16, 32, 64
#: Marks of a key's place: a slot of the unit is filled, or left blank.
FILLED_AT, BLANK_AT = 1 << 30, 1 << 29

# The syntaxes of template variables.
VARIABLE = re.compile(
    r"\{\{\{?\s*[\w.|\- ]{1,60}\s*\}?\}\}|\{%-?\s*[\w. ]{1,60}\s*-?%\}|<%[=-]?\s*[\w.@]{1,60}\s*%>|[$#]\{\s*[\w.]{1,60}\s*\}|%\([\w.]{1,60}\)[sd]|"
    r"\[\[\s*[\w. -]{1,60}\s*\]\]|%%[\w.]{2,60}%%|@@[\w.]{2,60}@@|\b__[A-Z][A-Z_.]{1,60}__\b|(?i:\[(?:insert|your|enter|add)[ _][\w. -]{1,60}\])|"
    r"<[A-Z][A-Z]*(?:_[A-Z]+)*>|(?<![\w$#{])\{[a-zA-Z_][\w.]{1,60}\}(?!\})|"
    r"\*\|[A-Z][A-Z0-9_:]{1,60}\|\*|(?<![\w%])%[A-Z][A-Z_]{2,60}%(?![\w%])|(?<![\w$])\$[a-z][a-z_]{1,60}\$(?![\w$])|\[[A-Z]{2,}(?:[ _][A-Z]{2,}){1,5}\]|<<\s*[A-Za-z_]{2,60}\s*>>"
)
_MARKS = re.compile(r"[{}\[\]<>%@$_*]")
# Names of fields left in capitals, and what programs print for a value that is missing.
_FIELD = re.compile(r"\b(?:(?:FIRST|LAST|FULL|USER|CUSTOMER|CLIENT|COMPANY|PRODUCT|SITE|EVENT|CITY|ORDER|INVOICE|COURSE|AUTHOR)(?:[ _-]?(?:NAME|NUMBER|DATE|TITLE|ID))|COMPANY|FIRSTNAME|LASTNAME|USERNAME)\b")
_MISSING = re.compile(r"\b(?:undefined|NaN|null)\b|\[object Object\]")
# Words behind which a value belongs.
_BLANK = re.compile(r"\b(?i:dear|hello|hi|on|at|to|by|for|from|in|of|is|hallo|am|um|von|bonjour|le|à|de|hola|el|en|por)(?: [,.!?;](?!\w)|(?P<gap>  +)[a-zß-ÿ.,])|\w [,.](?= |$)")
_GAP = re.compile(" {2,}")
# Words of a sentence that explains a variable or a filler instead of leaving it unfilled.
_EXPLAINS = re.compile(
    r"\b(?:such as|stands? for|for example|in the example|an? example|example of|called|named|means?|known as|turns? an?|replaces|written as|the mark|the tag|the variable|placeholders?|templates?|syntax|"
    r"steht für|bedeutet|zum beispiel|genannt|platzhalter|par exemple|signifie|remplace|appelée?|por ejemplo|significa|llamad[oa])\b", re.I
)
_SENTENCE = re.compile(r"(?<=[.!?])\s+")

# Filler of fresh sites and editors.
_FILLER_LINE = re.compile(
    r"(?:(?:your|insert|add|enter|type|put) (?:your )?(?:an? )?(?:short |own |new )?(?:text|title|headline|content|description|name|tagline|heading|caption|story)\b.{0,80}|lorem ipsum.{0,40}|(?:text ){3,}text|"
    r"placeholder (?:copy|text|content|image)\b.{0,80}|(?:todo|tbd|fixme|tk)\b[: ].{0,80}|this is (?:an? )?(?:sample|example|placeholder|dummy|test) (?:paragraph|text|page|post|sentence)\b.{0,120}|"
    r"welcome to your new (?:site|blog|page)\b.{0,140}|(?:hello world|sample page|just another .{1,40} site|content goes here|coming soon: content).{0,60}|.{0,40}\bgoes here\b.{0,60}|replace (?:it|this|me) with\b.{0,60}|.{0,60}\bclick to edit\b.{0,20}|edit or delete (?:it|this)\b.{0,80})\.?",
    re.I,
)
_FILLER_HINTS = frozenset("text title headline heading content description tagline caption story name lorem placeholder todo tbd fixme tk sample example dummy test welcome hello goes replace click edit another".split())
_FILLER_TITLE = re.compile(
    r"(?:your (?:title|headline|page title|text|name) here|(?:insert|add|enter) (?:a |your )?(?:title|headline|name)(?: here)?|(?:untitled|unnamed)(?: (?:document|page|post|\d+))?|(?:new|sample|example|test|blank|default) (?:page|post|document|site|title)(?: \d+)?|(?:page )?title(?: here)?|lorem ipsum.*|hello world!?|placeholder(?: title)?|no title|null|undefined|nan)",
    re.I,
)
# Words of the standard filler text.
LOREM = frozenset(
    "lorem ipsum dolor dolore dolora sit amet consectetur adipiscing adipisci elit sed do eiusmod tempor tempora incididunt incidunt ut et labore magna magnam aliqua aliquam enim ad minim minima veniam quis nostrud nostrum exercitation "
    "ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat fugit nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt "
    "mollit anim id est laborum quam vel porta viverra faucibus mauris vestibulum pellentesque curae".split()
)
#: Words of it that no other language's text is full of.
_LOREM_OWN = LOREM - B.STOP - frozenset("quam vel porta et est in ad ex ea eu do id non sit ut elit tempora minima dolor sint culpa magna nulla mauris".split())
# What error pages and script notices say: codes, things that are gone, and others.
_ERROR_CODE = re.compile(
    r"\b(?:4\d\d|5\d\d)\b.{0,30}\b(?:error|not found|forbidden|unavailable|no such|gone|bad|timeout|request|unauthori[sz]ed)|\b(?:error|status|code|ray|reference|fehler|erreur|error n|incident|request id)\s?(?:code|no\.?|n°|#|:)?\s?[#:]?\s?[0-9a-f]*\d{2,}",
    re.I,
)
_ERROR_GONE = re.compile(
    r"\b(?:page|file|document|entry|address|link|site|article|story|content|resource|thing|post|url)\b.{0,60}\b(?:(?:is|was|are|could|can|does|has|may)(?: have)?(?: not|n't|not)? (?:be )?(?:found|here|exist|available|gone|missing|moved|broken|dead|removed|deleted|load)|no longer (?:available|exists?|here)|never existed|not found|cannot be)",
    re.I,
)
_ERROR_OTHER = re.compile(
    r"\b(?:could not|couldn't|cannot|can't|unable to|failed to|were unable to)\b.{0,25}\b(?:find|load|connect|open|reach|display|process|complete|retrieve|access)\b|\bno such page\b|\b(?:page|file) not found\b|\bnot found\b|"
    r"\b(?:javascript|scripts?|scripting|client-side code|cookies)\b.{0,40}\b(?:enabled?|disabled|required|requires?|switched|turned|blocked|blocking|must|needed|on|off|run|allow)\b|\b(?:enable|allow|activate|turn on|requires?|needs?|blocking)\b.{0,20}\b(?:javascript|scripts|scripting|cookies)\b|"
    r"\b(?:activer|activez|aktivieren|schalten|einschalten|habilita|habilite|activa|active|attiva|ative|włącz|включите|aktivera|schakel)\b.{0,20}\bjavascript\b|\bjavascript\b.{0,40}\b(?:ein|an|inschakelen|aktiveras|activado)\b|"
    r"\b(?:account|site|domain|name|address|blog)\b.{0,40}\b(?:suspended|disabled|switched off|deactivated|parked|for sale|expired|terminated|under construction)\b|\bsession\b.{0,20}\b(?:expired|timed out|ended|invalid)\b|"
    r"\b(?:too many|more) (?:requests|connections|attempts)\b|\b(?:access|permission) (?:denied|refused)\b|\b(?:do not|don't|not) have (?:permission|access|the right)\b|\bmembers only\b|\bneeds an? (?:login|account|subscription)\b|\bnot available in your (?:country|region)\b|"
    r"\b(?:scheduled|down for|under|undergoing) (?:maintenance|repairs|an upgrade|upgrades?)\b|\bwill be back (?:soon|shortly|later)\b|\bservice (?:temporarily )?unavailable\b|\bdid not (?:answer|respond)\b|\btimed out\b|\btry (?:again|once more|later)\b|\bstack ?trace\b|\bfatal error\b|\bdatabase error\b|\bundefined (?:function|variable|index|method)\b|\bmemory size\b|\bunexpected (?:token|end|error)\b|\b(?:request|response) (?:failed|timed)\b|\bempty response\b|\bexception\b.{0,20}\bin\b|"
    r"\bindex of /|\bparent directory\b|\b(?:checking|verifying) (?:your|that you|if you|the) (?:browser|connection|are|human)\b|\b(?:prove|verify|confirm)\b.{0,20}\b(?:you are|human|person|not a robot)\b|\bjust a moment\b|\bunusual traffic\b|\bcaptcha\b|\bloading\b(?:\.\.\.|…|$)|\byour browser\b.{0,40}\b(?:old|out of date|outdated|unsupported|not supported|block|disabled)|"
    r"\b(?:something|things?) (?:went wrong|broke)\b|\boops\b|\bbroken link\b|\b(?:the start|home) ?page\b|"
    r"\bseite\b.{0,40}\b(?:nicht gefunden|existiert nicht|nicht mehr|verschoben)|\bnicht gefunden\b|\b(?:page|adresse|ressource)\b.{0,40}\b(?:introuvable|n'existe|déplacée|supprimée)|\bintrouvable\b|\b(?:página|dirección)\b.{0,60}\b(?:no encontrada|no existe)|\bno encontrad[ao]\b|\bpagina non trovata\b|\bpagina niet gevonden\b|\bsidan hittades inte\b|\bstrona nie (?:istnieje|została)\b|страниц[аы] не найден",
    re.I,
)
# In lower case, what each of these needs, so that most lines are not searched: a code one of these, a thing that is gone one of both, another message one of these.
_CODE_HINTS = ("error", "not found", "forbidden", "unavailable", "no such", "gone", "bad", "timeout", "request", "unauthori", "status", "code", "ray", "reference", "fehler", "erreur", "incident")
_THING_HINTS = ("page", "file", "document", "entry", "address", "link", "site", "article", "story", "content", "resource", "thing", "post", "url")
_GONE_HINTS = ("found", "here", "exist", "available", "gone", "missing", "moved", "broken", "dead", "removed", "deleted", "load", "cannot be")
_OTHER_HINTS = (
    "could not", "couldn't", "cannot", "can't", "unable to", "failed to", "no such page", "not found", "script", "client-side code", "cookies", "suspended", "disabled", "switched off", "deactivated", "parked", "for sale",
    "expired", "terminated", "under construction", "session", "requests", "connections", "attempts", "denied", "refused", "have permission", "have access", "have the right", "members only", "needs a", "not available in your",
    "maintenance", "repairs", "upgrade", "will be back", "unavailable", "did not answer", "did not respond", "timed out", "try again", "try once more", "try later", "stack trace", "stacktrace", "fatal error", "database error",
    "undefined", "memory size", "unexpected", "request failed", "request timed", "response failed", "response timed", "empty response", "exception", "index of /", "parent directory", "checking", "verifying", "prove", "verify",
    "confirm", "just a moment", "unusual traffic", "captcha", "loading", "your browser", "went wrong", "thing broke", "things broke", "oops", "broken link", "start page", "startpage", "home page", "homepage", "seite",
    "nicht gefunden", "introuvable", "n'existe", "déplacée", "supprimée", "no encontrad", "no existe", "pagina non trovata", "pagina niet gevonden", "sidan hittades inte", "strona nie", "страниц",
)
#: Characters that patterns without case take for others than their lower case.
_ODD_CASE = frozenset("\u0130\u0131\u017f\u212a\u1c80\u1c81\u1c82\u1c83\u1c84\u1c85\u1c86\u1c87\u1c88")
_ERROR_TITLE = re.compile(
    r"(?:(?:error|fehler|erreur|http) ?\d{3}\b.{0,30}|[45]\d\d\b ?[-:–]? ?(?:error|not found|no such page|forbidden|service unavailable|bad gateway|gateway time-?out|internal server error|unavailable|page not found|gone|access denied|.{0,3})|(?:page|file|site|document) not found.{0,3}|not found|access (?:denied|refused)|forbidden|account suspended|just a moment.{0,4}|loading.{0,4}|session expired|too many requests|members only|scheduled maintenance|under (?:maintenance|construction)|service unavailable|(?:fatal|database|server|internal server|application) error|warning|index of /.{0,60}|(?:this )?(?:name|domain|address|site)(?: name)? (?:is )?(?:for sale|parked)|bad gateway|attention required.{0,30}|are you a robot\??|security check|seite nicht gefunden|page introuvable|página no encontrada|pagina non trovata|page unavailable|enable javascript.{0,30}|javascript (?:is )?(?:required|disabled)|something went wrong|oops.{0,30}|site (?:off|un)line|coming soon)",
    re.I,
)
_TITLE_CUT = re.compile(r"\s+[|–—•·]\s+|\s+-\s+")

# Error messages and script notices that are known by their form, between other text too.
_MESSAGE_HINTS = frozenset("javascript java script scripts scripting error errors found line traceback denied sqlstate exception unavailable gateway forbidden warning notice".split())
_ENGINE = re.compile(r"\b(?:warning|(?:catchable |php )?fatal error|parse error|notice|deprecated|strict standards)\s*:\s.+\bin\s+\S+.*\bon line \d+", re.I)
_MESSAGE_LINE = re.compile(
    r"(?:http )?(?:error )?[45]\d\d\s*[:–-]?\s*(?:error\s*[:–-]?\s*)?(?:(?:page |file )?not found|forbidden|bad gateway|bad request|unauthori[sz]ed|(?:service|temporarily|service temporarily) unavailable|internal server error|gateway time-?out|gone)|(?:page|file|document) not found",
    re.I,
)
_MESSAGE = re.compile(
    r"error establishing an? \w+ connection\b|you have an error in your sql syntax\b|(?:php )?(?:fatal error: )?uncaught \w*(?:error|exception)\b.{0,4}[:'\"]|access denied for user '|traceback \(most recent call last\)|sqlstate\[|(?:database|mysql|sql|server|application|runtime|internal server) error\s*(?::|#|\(|\d)|"
    r"(?:sorry,? )?(?:the )?(?:requested )?(?:page|url|file|document|resource)(?: \S+)?(?: (?:that )?you (?:requested|wanted|(?:are|were) looking for|asked for))?(?: \S+)? (?:was not|wasn't|could not be|couldn't be|cannot be|can't be) found(?: on this (?:server|site))?\W*$|"
    r"please (?:enable|activate|turn on|switch on|allow) (?:your )?(?:java ?script|scripts|scripting)\b|you(?:'ll)? (?:need to|have to|must) (?:enable|activate|turn on|switch on|allow|have) (?:java ?script|scripts|scripting)\b|(?:enable|activate|turn on|switch on|allow) (?:java ?script|scripts|scripting)\b.{0,40}\bto (?:view|see|use|run|continue|load|read|watch|post)\b|"
    r"to (?:view|see|use|run|continue|load|read|watch|post)\b[^.]{0,80}?(?:please |you (?:need|have|must) (?:to )?)(?:enable|activate|turn on|switch on|allow) (?:java ?script|scripts|scripting)\b|"
    r"(?:java ?script|scripting|scripts) (?:is|are|must be|needs? to be|has to be|have to be|appears? to be|seems? to be) (?:currently )?(?:disabled|turned off|switched off|required|not enabled|blocked|needed|enabled|activated|turned on|switched on)(?:\W*$| (?:in|on|by) your (?:web )?browser\b| (?:for|on) this (?:site|page|app|form|feature)\b| to (?:view|see|use|run|continue|load|read|watch|post)\b)|"
    r"(?:this|our) (?:web ?site|web ?page|site|page|app|application|form|content|video|player|map|feature) (?:requires?|needs|(?:does not|doesn't|cannot|can't|won't) work (?:properly )?without) (?:java ?script|scripts|scripting)\b|your (?:web )?browser (?:has java ?script (?:disabled|turned off|switched off)|(?:does not|doesn't) support java ?script|blocks? (?:java ?script|scripts))\b|"
    r"(?:bitte )?(?:aktivieren|schalten) sie (?:bitte )?java ?script\b|veuillez activer (?:le )?java ?script\b|por favor,? (?:habilite|active) java ?script\b",
    re.I,
)
# Error titles that are everyday titles of articles as well; they count over short texts only.
_EVERYDAY_TITLE = re.compile(r"warning|forbidden|coming soon|members only|loading.{0,4}|just a moment.{0,4}|oops.{0,30}|something went wrong|security check|are you a robot\??|not found|access (?:denied|refused)|under construction|[45]\d\d\b ?[-:–]? ?.{0,3}", re.I)


#: Most words of a page, supported lines aside, that word lists may call an error message: they only settle what templates leave open.
SHORT_PAGE = 90
VAR, LATIN, MESSAGE, TITLE, TITLE_WORDS, TITLE_DAILY = 1, 2, 4, 8, 16, 32


def hashed(text: str) -> int:
    """64 bits of a text, the same on every worker."""
    return xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


# ------------------------------------------------------------------ keys: what makes two lines the same template

_W = B.WORD
_SEP = re.compile(r"\s*[:›»>|/·•–—]\s+|\s-\s")
#: Lowest bits of a key: of a shape with its first word open, of a frame with fewer than two fixed words, of a lead.
SHAPE, WEAK, LEAD = 1, 2, 4
#: Most words of a trail or a headline that repeats the page's title.
TRAIL_WORDS = 40
#: Words to one sign of a blank, at most, where the signs alone tell that slots were left open.
SIGN_WORDS = 20
SLOT = "\u25a1"
#: Characters before the mark behind a lead, at most.
SEP_AT = 40
# The full English names of the months.
_MONTHS = frozenset("january february march april may june july august september october november december".split())
_OPEN_WORDS = _MONTHS - {"may"} | {"null", "undefined", "nan"}


def frame(ws: list[str], host: str, cased: bool, plain: bool = False) -> tuple[list[str], bool]:
    """The fixed words of a text's words: those that aren't figures, inner capitalised words (where there is case to tell) or words of the site's name; and whether any is not.

    Records of one template come out equal whatever fills their slots. ``plain`` says that the words are ASCII, where small letters sort last.
    """
    first = ws[0].lower()
    if cased:
        fixed = [w for w in ws[1:] if w >= "a"] if plain else [w for w in ws[1:] if w[0].islower()]
        if first[0].isalpha() and not (len(first) > 4 and first in host):
            fixed.insert(0, first)
        if not _OPEN_WORDS.isdisjoint(fixed):
            fixed = [w for w in fixed if w not in _OPEN_WORDS]
    else:
        fixed = [w for x in ws if (w := x.lower())[0].isalpha() and w not in _OPEN_WORDS and not (len(w) > 4 and w in host)]
    return fixed, len(fixed) < len(ws)


def _key(mark: str, fixed: list[str], ws: list[str]) -> int:
    """Key of a frame: its fixed words; where they are fewer than two marked as weak, where there are none the words themselves. 0 without letters."""
    if len(fixed) >= 2:
        return hashed(mark + " ".join(fixed)) & ~7
    if fixed:
        return hashed(f"{mark}{fixed[0]} {SLOT}" if len(ws) > 1 else mark + fixed[0]) & ~7 | WEAK
    words = " ".join(w.lower() for w in ws if w.isalpha())
    return hashed(mark + "=" + words) & ~7 | WEAK if words else 0


def _units(s: str, host: str, kind: int, parts: list[str], words: list[list[str]], line: str, marks: int, plain: bool) -> tuple[tuple[tuple[int, int], ...], int]:
    """(key, ``FILLED_AT``, ``BLANK_AT`` or 0) of the units of a squeezed line (its ``parts``: sentences, or the whole), at any length, and the key of its lead or shape (0: none); ``words`` of each."""
    seen = {}
    cased = not (s.isupper() or s.islower())
    blank = _blank_parts(line, parts) if marks & BLANKS else ()
    fixed: list[str] = []
    for i, (x, ws) in enumerate(zip(parts, words, strict=True)):
        if ws:
            fixed, open_ = frame(ws, host, cased if len(parts) == 1 else not (x.isupper() or x.islower()), plain)
            if k := _key("s", fixed, ws):
                seen[k] = seen.get(k, 0) | (BLANK_AT if i in blank else FILLED_AT if open_ and not marks & OPEN else 0)
    units = tuple(seen.items())
    lead = 0
    if kind != B.PROSE or not B.ended(s):
        bulleted = not s[0].isalpha() and B._BULLET.match(s)
        bare = B._BULLET.sub("", s) if bulleted else s
        m = _SEP.search(bare, 0, SEP_AT + 4)  # blanks are single here: a mark has three characters at most
        if m and m.start() <= SEP_AT and 1 <= len(_W.findall(bare[: m.start()])) <= 4:
            lead = hashed("L" + " ".join(_W.findall(bare[: m.start()].lower())) + m.group().strip()) & ~7 | LEAD
        elif kind != B.PROSE and cased and bare[:1].isupper() and not (bulleted and s[0] in "-*•0123456789("):
            if bulleted or len(parts) > 1:
                ws = _W.findall(bare) if bulleted else [w for ws in words for w in ws]
                fixed = frame(ws, host, True, plain)[0]
            else:
                ws = words[0]  # the frame of the only part
            rest = fixed[1:] if fixed[:1] == [ws[0].lower()] else fixed
            if rest:
                lead = hashed("F" + " ".join(rest)) & ~7 | SHAPE
    return units, lead


def title_key(title: str | None, host: str = "") -> int:
    """Key of a title: its longest part besides the site's name. 0 without letters."""
    if not title or title.isspace():
        return 0
    parts = [(len(p), ws) for p in _TITLE_CUT.split(title.strip()) if (ws := _W.findall(p))]
    if not parts:
        return 0
    own = [x for x in parts if frame(x[1], host, True)[0]] or parts
    ws = max(own)[1]
    return _key("t", frame(ws, host, True)[0], ws)


# ------------------------------------------------------------------ facts of a line

_HASH = re.compile(r"(?:^|\s)#\w{3,}")
_HOST = re.compile(r"^(?:[•*·-]\s+|\d+[.)]\s+)?(?:https?://|www\.)?[\w-]+(?:\.[\w-]+)+(?:/\S*)?$")
_ITEMS = re.compile(r"\s*[,;|/·•]\s+|\s+[-–—]\s+")


_NO_LETTER = re.compile(r"[^\w ]|[\d_]")
_PLAIN = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ "


def _variables(line: str) -> int:
    """Unfilled variables of a line: those in sentences that don't explain them."""
    if not _MARKS.search(line) or not VARIABLE.search(line):
        return 0
    n = 0
    for sentence in _SENTENCE.split(line):
        found = VARIABLE.findall(sentence)
        if found and not _EXPLAINS.search(VARIABLE.sub(" ", sentence)):
            n += len(found)
    return n


def _open(line: str, kind: int) -> bool:
    """Whether a line left a variable's name in a slot."""
    if kind in (B.LOG, B.JUNK):
        return False
    if _variables(line):
        rest = VARIABLE.sub("", line)
        return kind != B.CODE or rest.strip(" .,:;") == "" or not re.search(r"[=;`]|\bfunction\b", rest)
    return False


def _blanks(line: str, s: str) -> int:
    """Signs that slots of a line were left blank, or at a default that programs print or forms show."""
    n = 0
    if "undefined" in s or "NaN" in s or "null" in s or "[object" in s:
        n += len(_MISSING.findall(s))
    if ("NAME" in s or "NUMBER" in s or "DATE" in s or "TITLE" in s or "ID" in s or "COMPANY" in s) and not s.isupper():
        n += len(_FIELD.findall(s))
    raw = line.strip()
    if " ," in raw or " ." in raw or " !" in raw or "  " in raw:
        found = list(_BLANK.finditer(raw))
        if sum(x["gap"] is not None for x in found) == len(_GAP.findall(raw)):  # else the line doubles its spaces anyway
            n += len(found)
    return n if n and not _EXPLAINS.search(s) else 0


def _dense_signs(line: str, k: int, n: int) -> bool:
    """Whether two of a line's ``n`` signs or more stand close, in the line of ``k`` words or in one of its sentences: over a long text, odd ones add up to nothing."""
    if n < 2 or n * SIGN_WORDS >= k:
        return n >= 2
    for x in _SENTENCE.split(line.strip()):
        n = _blanks(x, " ".join(x.split()))
        if n >= 2 and n * SIGN_WORDS >= len(x.split()):
            return True
    return False


def _blank_parts(line: str, parts: list[str] | tuple[str, ...]) -> set[int]:
    """Places of the sentences of a line with blanks that hold them; all where none does by itself."""
    raw = _SENTENCE.split(line.strip()) if len(parts) > 1 else ()
    own = {i for i, (x, y) in enumerate(zip(raw, parts, strict=True)) if _blanks(x, y)} if len(raw) == len(parts) else set()
    return own or set(range(len(parts)))


def line_facts(line: str, host: str, full: bool = True) -> tuple:
    """``_line_facts``, kept for short lines, which a site's pages repeat."""
    return _kept_facts(line, host, full) if len(line) <= 250 else _line_facts(line, host, full)


@lru_cache(maxsize=100_000)
def _kept_facts(line: str, host: str, full: bool) -> tuple:
    return _line_facts(line, host, full)


#: Blanks for all ASCII characters that stand in no word; line breaks and apostrophes stay.
_SPACED = bytes(c if chr(c).isalnum() or chr(c) in "\n'" else 32 for c in range(128)) + bytes(128)
_EDGE = re.compile(r"(?:^|[\s'])'|'(?:\s|$)")


def _words(line: str, low: str, s: str, kind: int) -> tuple[list[str], list[list[str]], list[str]]:
    """The sentences of a squeezed line (or the whole), the words of each, and all the line's words in lower case."""
    if kind in (B.PROSE, B.SHORT, B.ITEM) and (". " in s or "! " in s or "? " in s):
        s = s.replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n")  # ``_SENTENCE`` where blanks are single
    parts = s.split("\n")
    if line.isascii():
        spaced = s.encode().translate(_SPACED).decode()
        if "'" not in spaced or not _EDGE.search(spaced):  # apostrophes stand inside words
            return parts, [x.split() for x in spaced.split("\n")], spaced.lower().split()
    return parts, [_W.findall(x) for x in parts], _W.findall(low)


def _line_facts(line: str, host: str, full: bool = True) -> tuple:
    """(kind, characters, bytes, words, function words, marks, tag and address characters, odd characters, unit keys, lead key, the words) of a line that isn't blank.

    Unless ``full``, ``ITEMS`` isn't marked and tag, address and odd characters aren't counted: only problems 1, 2 and 5 ask for them.
    """
    low = line.lower()
    kind, k, stops = B.kind(line, low.split())
    s = line.strip() if "  " not in line and line.isprintable() else " ".join(line.split())
    n = len(s)
    plain = line.isascii()
    parts, words, ws = _words(line, low, s, kind)
    marks = ENDED if B.ended(s) else 0
    odd = tags = 0
    if full:
        odd = len(s.encode().translate(None, _PLAIN)) if s.isascii() else len(_NO_LETTER.findall(s))
        if stops * 4 < k and n > 12 and len(_ITEMS.findall(s)) >= 3:
            marks |= ITEMS
        if stops * 4 < k or not stops:
            if "#" in s:
                tags = sum(len(x.strip()) for x in _HASH.findall(s))
            if "." in s and _HOST.match(s):
                tags = n
    if _open(line, kind):
        marks |= OPEN
    if kind in (B.PROSE, B.SHORT, B.ITEM):
        if b := _blanks(line, s):
            marks |= OPEN if _dense_signs(line, k, b) else BLANKS
        if (k < 4 or stops * 2 < k) and not _FILLER_HINTS.isdisjoint(ws) and _FILLER_LINE.fullmatch(B._bare(s)):
            marks |= FILLER
    if not _MESSAGE_HINTS.isdisjoint(ws) or "error" in low or "exception" in low:
        marks |= HINTED
    units, lead = _units(s, host, kind, parts, words, line, marks, plain) if ws else ((), 0)
    return kind, n, len(line) if plain else len(line.encode("utf-8", "surrogatepass")), k, stops, marks, tags, odd, units, lead, ws


def _message(line: str, before: str) -> bool:
    """Whether a line holds an error message or a script notice by its form, unless it or the line ``before`` explains it."""
    if before.rstrip().endswith(":") or (before and _EXPLAINS.search(_SENTENCE.split(before.rstrip())[-1])):
        return False
    bare = B.bare(line)
    if (not line.isascii() or "on line " in line.lower()) and _ENGINE.search(line):
        return not _EXPLAINS.search(_ENGINE.sub(" ", line))
    if _MESSAGE_LINE.fullmatch(bare.rstrip(" .!")):
        return True
    return any(_MESSAGE.match(x) and not _EXPLAINS.search(x) for x in _SENTENCE.split(bare))


# ------------------------------------------------------------------ states of chunks


def partial(text: str, host: str = "", full: bool = True) -> list:
    """[facts of the closed lines (None: blank), first piece, last piece or None where the chunk holds no line break, lines as read]"""
    lines = text.split("\n")
    inner = lines[1:-1]
    return [[line_facts(x, host, full) if x.strip() else None for x in inner], lines[0], lines[-1] if len(lines) > 1 else None, inner]


def merge(a: list, b: list, host: str = "", full: bool = True) -> list:
    """The state of two adjacent chunks: the open pieces that meet make a line, read as a whole. Associative; ``partial("")`` is neutral."""
    if a[2] is None:
        return [b[0], a[1] + b[1], b[2], b[3]]
    met = a[2] + b[1]
    if b[2] is None:
        return [a[0], a[1], met, a[3]]
    return [a[0] + [line_facts(met, host, full) if met.strip() else None] + b[0], a[1], b[2], a[3] + [met] + b[3]]


def finish(state: list, host: str = "", full: bool = True) -> tuple[list, list[str]]:
    """(facts of all lines in order, the lines)"""
    closed, first, last, texts = state
    one = lambda x: line_facts(x, host, full) if x.strip() else None
    if last is None:
        return [one(first)], [first]
    return [one(first), *closed, one(last)], [first, *texts, last]


def read(text: str, host: str = "", full: bool = True) -> tuple[list, list[str]]:
    """Facts of all lines of a text, and the lines; ``full`` as in ``_line_facts``."""
    return finish(partial(text, host, full), host, full)


# ------------------------------------------------------------------ counts (problem 1)

#: Positions in a vector of counts.
N_LINES, N_BLANK, N_CHARS, N_WORDS, STOPS, ENDED_LINES, ODD, DENSE_CHARS, ENDED_CHARS, SPACES = range(10)
WIDTH = 10


def counts(facts: list) -> list[int]:
    """Counts over lines, each a sum over them: they merge by addition."""
    v = [0] * WIDTH
    for f in facts:
        if f is None:
            v[N_BLANK] += 1
            continue
        kind, n, _, k, stops, marks, _, odd, _, _, _ = f
        v[N_LINES] += 1
        v[N_CHARS] += n
        v[N_WORDS] += k
        v[STOPS] += stops
        v[ODD] += odd
        v[SPACES] += k - 1
        if marks & ENDED:
            v[ENDED_LINES] += 1
            v[ENDED_CHARS] += n
        if dense(k, stops):
            v[DENSE_CHARS] += n
    return v


def dense(k: int, stops: int) -> bool:
    """Whether a line's words are common ones as a sentence's are."""
    return stops * 5 >= k


def prose(v: list[int]) -> bool:
    """Whether counted text is natural prose, by its ratios.

    Common words make up a fifth of its words and most of its characters stand in lines dense with
    them. Prose in a language whose common words are not known shows in long lines that end in
    punctuation, words of ordinary length and few symbols and figures.
    """
    n, words = v[N_CHARS], v[N_WORDS]
    if not n:
        return False
    if v[STOPS] * 5 >= words and v[DENSE_CHARS] * 5 >= n * 3:
        return True
    solid = n - v[SPACES]
    return v[STOPS] * 8 < words and words >= 12 * v[N_LINES] and v[ENDED_CHARS] * 2 >= n and 3 * words <= solid <= 8 * words and v[ODD] * 20 <= solid


# ------------------------------------------------------------------ repeats (problem 2)


def clausal(k: int, stops: int) -> bool:
    """Whether a line's words make clauses: as many common ones as whole sentences have."""
    return k >= 8 and stops * 100 >= 36 * k


def cover(facts: list) -> tuple[list[int], list[int], list[int]]:
    """For each line that isn't blank: characters of its words, those in repeats of two words or more, and those in repeats that occur three times, in the whole page.

    Lines of clauses hold no keywords: nothing of them counts as covered, nor as a repeat of another line.
    """
    words: list = []
    starts, place, solid = [], [], []
    for f in facts:
        if f is None:
            continue
        if f[10] and not clausal(f[3], f[4]):
            place.append(len(solid))
            starts.append(len(words))
            words += f[10]
            words.append((len(starts),))  # the end of a line, like no other: no repeat crosses it
        solid.append(sum(map(len, f[10])))
    long, often = [0] * len(solid), [0] * len(solid)
    if words:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        sizes[[*(s - 1 for s in starts[1:]), len(words) - 1]] = 0
        _, two, three = repeat_marks(words)
        for i, a, b in zip(place, np.add.reduceat(sizes * two, starts).tolist(), np.add.reduceat(sizes * three, starts).tolist(), strict=True):
            long[i], often[i] = a, b
    return solid, long, often


# ------------------------------------------------------------------ the page


@lru_cache(maxsize=50_000)
def _reads_as_error(line: str) -> bool:
    """Whether a line says what error pages and script notices say; searched only for what its words allow."""
    has = line.lower().__contains__
    odd = not line.isascii() and not _ODD_CASE.isdisjoint(line)
    return (
        (odd or any(map(has, _OTHER_HINTS))) and _ERROR_OTHER.search(line) is not None
        or (odd or any(map(has, _GONE_HINTS)) and any(map(has, _THING_HINTS))) and _ERROR_GONE.search(line) is not None
        or (odd or any(map(has, _CODE_HINTS)) and B._DIGIT.search(line) is not None) and _ERROR_CODE.search(line) is not None
    )


#: Columns that ``page`` gives: key of the title, bits of what shows by form, arrays over the lines that aren't blank, and the page's keys with their lines.
PAGE = (
    "title bigint, bits int, numbers array<int>, sizes array<int>, kinds array<int>, chars array<int>, words array<int>, stops array<int>, marks array<int>, tags array<int>, odd array<int>, "
    "solid array<int>, long array<int>, often array<int>, n_units array<int>, keys array<bigint>, key_at array<int>"
)

#: Those of them that only problems 1, 2 and 5 ask.
FULL = ("numbers", "chars", "stops", "tags", "odd", "solid", "long", "often")


def page(host: str, title: str | None, facts: list, lines: list[str], full: bool = True) -> tuple:
    """What the operators need of a page, a value for each column of ``PAGE``; what only problems 1, 2 and 5 ask stays empty unless ``full``."""
    shown = [(no, f, x) for no, (f, x) in enumerate(zip(facts, lines, strict=True), 1) if f is not None]
    columns = list(zip(*(f for _, f, _ in shown), strict=True)) or [()] * 11
    kinds, marks = list(columns[0]), list(columns[5])
    solid, long, often = cover(facts) if full else ([], [], [])
    heading = B.bare(title).casefold() if title else ""
    heads = [B.bare(x).casefold() for x in _TITLE_CUT.split(title.strip())] if heading else []
    total = sum(f[3] for _, f, _ in shown if f[0] in (B.PROSE, B.SHORT, B.ITEM))
    short = total <= 2 * SHORT_PAGE
    tails = [h[-9:] for h in heads]
    bits = lorem = words = telling = 0
    before = ""
    for i, (_, (kind, _, _, k, stops, mark, _, _, _, _, ws), line) in enumerate(shown):
        if heading and k <= TRAIL_WORDS and kind in (B.SHORT, B.ITEM, B.PROSE, B.TABLE) and (len(line) <= len(heading) + 12 or any(map(line.casefold().__contains__, tails))):
            b = B.bare(line).casefold()
            if kinds[i] in (B.SHORT, B.ITEM) and len(b) > 8 and b in heading:
                kinds[i] = B.PROSE  # a headline that is the page's title
            elif any(len(b) > len(h) > 8 and b.endswith(h) for h in heads) and _SEP.search(b):
                kinds[i] = B.BOILER  # a trail that ends in it
        if kind == B.SHORT and kinds[i] == B.SHORT and stops and line.lstrip(" >\t")[:1].islower():
            kinds[i] = B.PROSE  # a sentence in passing, no heading
        if mark & OPEN:
            bits |= VAR
        if mark & HINTED and not bits & MESSAGE and _message(line, before):
            bits |= MESSAGE
        before = line
        words += k
        if stops * 4 < k and k >= 3:
            hit = sum(map(LOREM.__contains__, ws))
            if hit * 3 >= k:
                lorem += k
                telling += sum(map(_LOREM_OWN.__contains__, ws))
        if short and kind in (B.PROSE, B.SHORT, B.ITEM) and _reads_as_error(line):
            marks[i] |= NOTICE
    if telling >= 2 and lorem * 3 >= words:
        bits |= LATIN
    if title and not title.isspace():
        whole = title.strip()
        parts = [whole, *(p.strip() for p in _TITLE_CUT.split(whole))]
        if _MARKS.search(whole) and any(VARIABLE.fullmatch(p) for p in parts):
            bits |= TITLE
        elif any(_FILLER_TITLE.fullmatch(p) or (_ERROR_TITLE.fullmatch(p) and not _EVERYDAY_TITLE.fullmatch(p)) for p in parts):
            bits |= TITLE_WORDS
        elif any(_EVERYDAY_TITLE.fullmatch(p) for p in parts):
            bits |= TITLE_DAILY
    keys, key_at = [], []
    for i, (_, f, _) in enumerate(shown):
        for k, mark in f[8]:
            keys.append(k)
            key_at.append(i + mark)
        if f[9]:
            keys.append(f[9])
            key_at.append(i)
    name = title_key(title, host)
    if name:
        keys.append(name)
        key_at.append(len(shown))  # the title stands behind the last line
    own = lambda i: columns[i] if full else ()
    return (
        name, bits, [no for no, _, _ in shown] if full else (), columns[2], kinds, own(1), columns[3], own(4), marks, own(6), own(7), solid, long, often,
        list(map(len, columns[8])), keys, key_at,
    )
