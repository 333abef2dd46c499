"""Problem 2: entries of pos and neg that fail as a reply to their query, each with its defect.

Every (query, entry) pair is judged on the executor that holds its record; nothing is shuffled. The judges, in the order
in which the first that objects names the defect:

- empty: null, nothing but white space, punctuation and tags, or a stand-in for a missing text.
- refusal: an automaton over refusing phrases; each sentence must refuse or be a courtesy around a refusal.
- copy: the query's suffix automaton (over words, and single characters in Chinese) is traversed with the entry; the
  stretches that it matches must cover the query, and leave a few words of introduction at most.
- language: votes of stopwords and scripts, against the query's own votes and the language that it asks for.
- truncated: a delimiter stack that is not closed, a hanging comma or the like, or a last word after which sentences do
  not end. The last is decided by a model of sentence ends, fitted on all records: how often each context of one to five
  words ends a sentence, and which words follow each other. Its counts are stated for PER_ROWS records, so that their
  thresholds are shares and the model is bounded by them, however many records there are.

Defined results: records with a null or blank query give nothing; a null or empty pos is one case (pos, 0, empty), a null
or empty neg none; entries of sources tagged [CLS] can only be empty; repeated rows are judged each; an empty table gives
no rows; a source that the task table lacks has no tag; other columns are ignored. Whole texts are judged.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.session import spread, staged, work_dir

#: Counts of the model of sentence ends are those of all records, divided to so many.
PER_ROWS = 6_000
#: Words of a piece in which contexts are counted.
PIECE = 3_000_000
#: Words of a part, in which texts are handed on.
PART = 100_000
#: Rows of the task table, which goes to every executor.
MAX_SOURCES = 1_000_000
#: Longer than any stand-in: without a tag, such a text can only be empty of letters.
LONGEST_STAND_IN = 80
#: Words of a sentence that refuses or is a courtesy; in Chinese twice as many characters.
LONGEST_REFUSAL = 40
#: With fewer words to a line, line ends are no sentence ends.
WRAPPED = 4
#: Words (characters in Chinese) that an introduction to a copy may have.
INTRO_WORDS, INTRO_CHARS = 4, 6
#: Longest context of the model of sentence ends, least occurrences of a context, and the share of ends up to which it counts as none.
CONTEXT, LEAST, NEVER = 5, 6, 0.02
#: Up to this share of ends a word may be cut off where the pair of words is unknown as an end.
SELDOM = 0.15
#: A text of so many words (characters in Chinese) may be a label, which is complete as it is.
LABEL_WORDS, LABEL_CHARS = 3, 5
#: A word that is no function word must have been seen so often before it counts as one that ends no sentence.
LEAST_CONTENT = 150
#: Cases that a shorter context counts as, beside the longer one's own.
SMOOTH = 5

_ZERO_WIDTH = re.compile("[\u00ad\u180e\u200b-\u200f\u2060\ufeff]")
_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9]{0,15}\s*/?>")
_LETTER = re.compile(r"[^\W_]")
_TOKEN = re.compile(r"([\u3040-\u30ff\u3400-\u9fff]|[^\W_\u3040-\u30ff\u3400-\u9fff]+)([\W_]*)")
_WORD = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]|[^\W_\u3040-\u30ff\u3400-\u9fff]+")
_ASCII_WORD = re.compile(r"[A-Za-z0-9]+")
_CJK = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]")
_ASCII_PARTS, _PARTS = re.compile(r"([A-Za-z0-9]+)"), re.compile(r"([^\W_]+)")
_HAN = re.compile(r"[\u3400-\u9fff]")
_HAN_GAP = re.compile(r"(?<=[\u3400-\u9fff，。])[ \u00a0\u3000]+(?=[\u3400-\u9fff，。！？])")
_END = re.compile(r"[.!?]+[\"'”’»)\]*]*(?:\s|$)|[。！？]")
_BULLET = re.compile(r"\n\s*(?:[-*•–]|\d{1,3}[.)])\s*$")
_ITEM = re.compile(r"^\s*(?:[-*•–]|\d{1,3}[.)])\s", re.MULTILINE)
_SENTENCE = re.compile(r"(?<=[.!?])[\"'”’»)]*\s+|(?<=[。！？])|\n+")
_ELLIPSIS = re.compile(r"(?:…|\.\.\.|\[\s*(?:…|\.\.\.)\s*\])+\s*$")
#: Marks around a text that do not belong to it.
_AFTER = re.compile(r"(?:\s|\*\*|\[\d{1,3}\]|[(\[]edited[)\]]|[\U0001f000-\U0001faff\u2600-\u27bf\ufe0f\U0001f3fb-\U0001f3ff]|\betc\.)+$", re.IGNORECASE)
_BEFORE = re.compile(r"^(?:\s|\*\*|>|[-*•–]\s)+")
_HANGING = re.compile(r"[,;，、；：:(\[{“„«「『（–—/&+=\\-]\s*$")
_CODE = re.compile(
    r"[{}]\s*(?:\n|$)|^[^\n]*[(=\[][^\n]*;\s*$|^\s*(?:def|fn|function|class|func|pub|impl|struct)\s+\w+|^\s*(?:for|while|if)\s*\(|^\s*(?:select|insert|update|create)\b.+\b(?:from|into|set|table)\b|\breturn\b.+[\[(;]|=>|->|\w\(\w*\)\s*[{:]|\|\s*sort\b|\b\w+\[\w+\]",
    re.IGNORECASE | re.MULTILINE | re.DOTALL,
)
_CODE_HANGING = re.compile(r"(?:[,=+\-*/|&<>({\[\\:.]|\b(?:and|or|not|in|for|if|else|return|where|from|select|group|by|as|order|let|def|fn|count|is))\s*$", re.IGNORECASE)
_TRAILING = " \t\n\u00a0\u3000\"'”’»)]*_」』）"
_CLOSERS = {")": "(", "]": "[", "}": "{", "）": "（", "”": "“", "»": "«", "」": "「", "』": "『", "】": "【", "》": "《"}
_OPENERS = set(_CLOSERS.values())

#: Stand-ins for a missing text, without the punctuation around them.
STAND_INS = frozenset("""
n/a|na|nan|null|none|tbd|tba|tbc|todo|undefined|removed|deleted|no answer|no answer yet|no response|not available|not provided|not specified|no data|no text|
empty answer|placeholder|lorem ipsum|answer|a|response|reply|leer|keine angabe|keine antwort|k. a|k.a|ohne antwort|nicht verfügbar|antwort|vide|sans réponse|aucune réponse|
non renseigné|non disponible|réponse|vacío|sin respuesta|no disponible|respuesta|无|暂无|暂无回答|无回答|没有回答|未填写|空|待补充|答|回答|答案
""".replace("\n", "").split("|"))
#: Stand-ins only in brackets or tags, since they may be labels without.
BRACKETED = frozenset("empty|blank|missing|void|unknown|nothing|ninguna|aucune|keine|待定|nil|redacted|hidden|unavailable".split("|"))

#: Phrases that refuse, and courtesies that may surround a refusal; lower case, straight apostrophes.
REFUSALS = """
i can't help with|i cannot help with|i can not help with|i can't assist|i cannot assist|i can't answer|i cannot answer|i can't provide|i cannot provide|i can't give|i cannot give|i can't comply|i cannot comply|i can't discuss|i cannot discuss|i can't share|i cannot share|i can't respond|i cannot respond|i can't tell you|i cannot tell you|i can't say|i cannot say|i couldn't answer|
i can't fulfil|i cannot fulfil|i can't offer|i cannot offer|i can't do that|i cannot do that|i can't talk about|i cannot talk about|i can't support|i cannot support|i can't process|i cannot process|i can't complete|i cannot complete|i can't generate|i cannot generate|i can't produce|i cannot produce|i can't write|i cannot write|
unable to answer|unable to help|unable to assist|unable to provide|unable to respond|unable to comply|unable to give|unable to discuss|unable to share|unable to process|unable to say|not able to answer|not able to assist|not able to help|not able to provide|not able to respond|not able to give|not able to discuss|not able to say|
won't be able to|will not be able to|must decline|have to decline|i decline|i'd rather not|i would rather not|i have to pass on|i must pass on|i'll have to pass|against my guidelines|against my policy|against my programming|violates my|not allowed to|not permitted to|not in a position to|i refuse to|i must refuse|have to refuse|
don't have enough information|do not have enough information|don't have sufficient information|do not have sufficient information|don't have that information|do not have that information|don't have any information|do not have any information|don't have access to|do not have access to|no information on this|no information about this|i don't know|i do not know|i have no answer|i don't have an answer|i do not have an answer|i have no idea|
not something i can|beyond my|outside my|outside the scope of what i|not comfortable|i'm not sure how to answer|cannot be answered|can't be answered|
kann ich nicht beantworten|frage nicht beantworten|nicht beantworten|keine auskunft geben|keine auskunft|bitte ablehnen|anfrage ablehnen|muss ich ablehnen|muss das ablehnen|eine antwort hier nicht möglich|antwort ist mir nicht möglich|nicht weiterhelfen|nicht helfen|keine antwort geben|nichts dazu sagen|dazu nichts sagen|weiß ich nicht|weiß ich leider nicht|ich weiß es nicht|nicht genug informationen|nicht genügend informationen|fehlen mir die informationen|keine informationen|nicht bearbeiten|nicht unterstützen|verstößt gegen meine|gegen meine richtlinien|nicht befugt|kann dazu keine|kann ihnen dazu|
je ne peux pas répondre|je ne peux pas vous aider|je ne peux pas aider|je ne peux pas fournir|je ne peux pas donner|je ne peux pas traiter|je ne peux pas en parler|je ne peux pas vous|je ne puis|pas en mesure de|il m'est impossible de|impossible de répondre|je dois refuser|refuser d'en parler|je dois décliner|je ne sais pas|je ne dispose pas|je n'ai pas assez d'information|je n'ai pas suffisamment d'information|je n'ai pas d'information|je n'ai pas les informations|contraire à mes|contre mes règles|contre mes directives|je préfère ne pas|je ne suis pas autorisé|
no puedo responder|no puedo contestar|no puedo ayudar|no puedo proporcionar|no puedo dar|no puedo ofrecer|no puedo hablar|no puedo tratar|no puedo facilitar|no me es posible|no es posible responder|no dispongo de|no tengo información|no tengo suficiente información|no cuento con|debo negarme|tengo que negarme|debo rechazar|tengo que rechazar|debo declinar|no lo sé|no sé la respuesta|no sabría|va en contra de mis|iría en contra de mis|contra mis normas|prefiero no|no estoy autorizad|no estoy en condiciones|no soy capaz|
无法回答|不能回答|无法提供|不能提供|无法帮助|不能帮助|无法协助|不能协助|帮不上忙|拒绝讨论|拒绝回答|必须拒绝|无法讨论|不能讨论|无法处理|不能处理|无可奉告|没有足够的信息|信息不足|不知道答案|我不知道|我也不知道|不便回答|不便透露|违反我的|不符合我的|超出我的|没有相关信息|没有办法回答|没法回答|恕难|不予回答|无法给出|不能给出|无法作答|不能作答
""".replace("\n", "").split("|")
COURTESIES = """
thank you for|thanks for|rephrase your question|consult a|consult an|anything else|another question|at the moment|sorry|i apologise|i apologize|my apologies|unfortunately|i'm afraid|as a language|as an ai|as an assistant|to be honest|at this time|i hope you understand|please understand|contact a|please ask|feel free to|let me know if|is there something else|can i help you with|
wenden sie sich|sonst noch etwas|es tut mir leid|entschuldigung|leider|vielen dank|danke für|bitte fragen sie|ich bitte um verständnis|verständnis|formulieren sie|als sprachassistent|als assistent|andere frage|bedaure|
puis-je vous aider|veuillez consulter|je suis désolé|désolé|désolée|malheureusement|pardon|merci de|merci pour|reformuler|autre question|en tant qu'|je regrette|n'hésitez pas|
puedo ayudarle|puedo ayudarte|consulte a|consulta a|lo siento|disculpe|disculpa|lamentablemente|gracias por|reformul|otra pregunta|otra cosa|lamento|como asistente|desafortunadamente|
请咨询|其他问题|其它问题|对不起|抱歉|很遗憾|非常遗憾|遗憾|感谢|谢谢|作为语言|作为一个|作为助手|请谅解|敬请谅解|换个问题|换一个问题|还有什么
""".replace("\n", "").split("|")

#: Frequent function words; those of two languages vote for both.
STOPWORDS = {
    "en": "the and of is to with a an it for that this by in on are be not do does how what when which why you my between if or as from at into both while after before until unless about then than more less most some there no need say says their its was were can could should would your we they his her has have had but because where so over under out each every during without whenever though these those",
    "de": "der die das und ist nicht mit ein eine einen einem einer man den dem des für auf sich im in beim vom am an ob zu zum zur wird wie was wenn oder sollte auch dann sind es kein keine keinen kann nach als warum ich muss wirklich wer etwas noch ab bei aus weil bevor sobald solange nachdem obwohl falls während von sie er wir ihr mein dass war hat haben werden nur so sehr mehr meistens länger genug danach zuerst schluss viele trotzdem wichtiger später früh alle jede jeder über unter",
    "fr": "le la les est et une un du de des que qui dans pour avec il elle on sur plus faut ne pas l d c s n j qu ce cette ces être au aux en ou où quand après avant comment pourquoi quelle quel tant même si rien peut tous toutes sont reste devient mieux vaut puis pendant parce sans entre leur leurs vous nous je me ma mon ses son sa aussi très peu dit disent environ parfois plutôt assez enfin ensuite chaque moins jusqu",
    "es": "el la los las y es una un uno unos unas del de que en para con se lo por más hay al sin no nada como cómo cuál qué cuando pero está están su sus antes después hasta mientras porque desde sobre entre muy suele puede conviene primero luego aunque pocos saben si nadie todas todos cada este esta eso ha han ser fue cual donde dónde mejor unas bastan también ya me mi te tu o u menos durante",
}
#: Words after which hardly any sentence ends.
HANGING_WORDS = frozenset(
    "the a an and or but because if when while of with from into than very every both would should could must my your their its"
    " der die das den dem ein eine einen einem einer und oder aber weil wenn dass als sehr jede zum zur im beim vom"
    " le la les un une des du de et ou mais avec parce que qui très jamais"
    " el los las unos unas y pero con porque muy del al nunca".split()
)
#: Further words that rarely end a sentence; they count if no sentence was seen to end in them after the same word.
RARELY_LAST = frozenset(
    "that only which who whose although though unless whereas since until till whenever wherever whether nor than as even just also such each every its his our their"
    " sondern sowie dass obwohl während sobald solange falls damit indem bevor nachdem sofern weder entweder sowohl nur auch sogar deren dessen welche welcher welches"
    " lorsque puisque car donc quoique tandis dont lequel laquelle quand comme ni soit seulement aussi même chaque leur"
    " aunque sino según cuya cuyo mientras cuando donde si ni solo también incluso cada cual cuyos su sus".split()
)
#: Chinese words that join on what follows.
JOINING = ("如果", "以及", "因为", "但是", "而且", "虽然", "所以", "并且", "或者", "然而", "不过", "由于", "为了", "除非", "即使", "既然", "无论", "尽管", "只要", "只有", "和", "与", "及", "或", "而", "但", "且", "把", "被")
_REQUESTED = {
    "en": re.compile(r"\benglish\b|\benglisch|\banglais|\binglés|英语|英文", re.IGNORECASE),
    "de": re.compile(r"\bgerman\b|\bdeutsch|\ballemand|\balemán|德语|德文", re.IGNORECASE),
    "fr": re.compile(r"\bfrench\b|\bfranzösisch|\bfrançais|\bfrancés|法语|法文", re.IGNORECASE),
    "es": re.compile(r"\bspanish\b|\bspanisch|\bespagnol|\bespañol|\bcastellano|西班牙语|西班牙文", re.IGNORECASE),
    "zh": re.compile(r"\bchinese\b|\bmandarin|\bchinesisch|\bchinois|\bchino\b|中文|汉语|普通话", re.IGNORECASE),
}
_LANGS = ("en", "de", "fr", "es", "zh")
_VOTES: dict[str, int] = {}
#: The same in 15 bits a language, so that the sum over fewer words is one machine word.
_FEW_VOTES: dict[str, int] = {}
for _k, _lang in enumerate(_LANGS[:4]):
    for _w in set(STOPWORDS[_lang].split()):
        _VOTES[_w] = _VOTES.get(_w, 0) + (1 << 24 * _k)
        _FEW_VOTES[_w] = _FEW_VOTES.get(_w, 0) + (1 << 15 * _k)


def clean(text: str) -> str:
    """Without zero-width characters, soft hyphens and blanks between ideographs, straight apostrophes, one kind of line end."""
    if not text.isascii():
        text = _HAN_GAP.sub("", _ZERO_WIDTH.sub("", text).replace("’", "'"))
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


def words_in(text: str) -> list[str]:
    """What _WORD finds."""
    return (_ASCII_WORD if text.isascii() else _WORD).findall(text)


def tokens_in(text: str) -> tuple[list[str], list[str]]:
    """What _TOKEN finds: words, and what stands after each."""
    if text.isascii():
        parts = _ASCII_PARTS.split(text)
    elif not _CJK.search(text):
        parts = _PARTS.split(text)
    else:
        cut = _TOKEN.findall(text)
        return [w for w, _ in cut], [gap for _, gap in cut]
    return parts[1::2], parts[2::2]


def is_empty(text: str | None) -> bool:
    if text is None:
        return True
    text = text.strip()
    if len(text) > LONGEST_STAND_IN and "<" not in text:
        return all(unclear(c) for c in text)
    s = _TAG.sub(" ", clean(text)).strip()
    if not s or all(unclear(c) for c in s):
        return True
    bare = s.strip(" \t\n\u3000\u00a0.:!?*_\"'“”„«»-–—…：。！？·•>").casefold()
    inner = bare.strip("()[]{}<>（）【】〈〉 ")
    return re.sub(r"\s+", " ", inner) in STAND_INS or (inner != bare and inner in BRACKETED) or not inner


def unclear(c: str) -> bool:
    """Nothing that a reader could take for content: white space, punctuation, ASCII symbols, control characters."""
    return not c.isalnum() and (ord(c) < 0x2600 or 0x3000 <= ord(c) < 0x3040 or 0xFE00 <= ord(c) < 0x10000)


def has_text(text: str | None) -> bool:
    return text is not None and any(not c.isspace() and not _ZERO_WIDTH.match(c) for c in text)


class SuffixAutomaton:
    """Of a sequence of hashable units; run() finds, at each place of another sequence, the longest suffix that occurs in it."""

    __slots__ = ("after", "link", "length", "end")

    def __init__(self, units: list[str]):
        after: list[dict] = [{}]
        link, length, end, last = [-1], [0], [0], 0
        for i, u in enumerate(units):
            cur = len(after)
            after.append({})
            link.append(0)
            length.append(length[last] + 1)
            end.append(i + 1)
            p = last
            while p >= 0 and u not in after[p]:
                after[p][u] = cur
                p = link[p]
            if p >= 0:
                q = after[p][u]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    twin = len(after)
                    after.append(dict(after[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    end.append(end[q])
                    while p >= 0 and after[p].get(u) == q:
                        after[p][u] = twin
                        p = link[p]
                    link[q] = link[cur] = twin
            last = cur
        self.after, self.link, self.length, self.end = after, link, length, end

    def run(self, units: list[str]) -> list[tuple[int, int]]:
        """(length of the longest match that ends here, its end in the automaton's own sequence) for each unit."""
        after, link, length, end = self.after, self.link, self.length, self.end
        state = n = 0
        out = []
        for u in units:
            while state and u not in after[state]:
                state = link[state]
                n = length[state]
            if u in after[state]:
                state = after[state][u]
                n += 1
            else:
                n = 0
            out.append((n, end[state]))
        return out


def is_copy(query: list[str], entry: list[str], automaton: dict, least: int = 3) -> bool:
    """Do stretches of the query cover all of it (a tenth may miss) and all of the entry but an introduction?"""
    nq = len(query)
    if not nq or len(entry) < nq * 0.9:
        return False
    if nq < least:
        return entry == query
    strange = 0
    if "own" not in automaton:
        automaton["own"] = frozenset(query)
    own = automaton["own"]
    for u in entry:
        if u not in own:
            strange += 1
            if strange > INTRO_CHARS:  # more than an introduction in any case
                return False
    if "sam" not in automaton:
        automaton["sam"] = SuffixAutomaton(query)
    covered, seen, at = [False] * len(entry), [False] * nq, automaton["sam"].run(entry)
    for i, (n, end) in enumerate(at):
        if n >= least and (i + 1 == len(at) or at[i + 1][0] <= n):  # a maximal stretch
            covered[i + 1 - n : i + 1] = [True] * n
            seen[end - n : end] = [True] * n
    rest = [u for u, c in zip(entry, covered) if not c]
    words = sum(not _HAN.match(u) for u in rest)
    return sum(seen) >= 0.9 * nq and words <= INTRO_WORDS and len(rest) <= INTRO_CHARS and len(rest) <= max(2, nq)


def votes_of(words: list[str]) -> tuple[int, ...]:
    """Votes for en, de, fr, es, zh."""
    bits, votes = (15, _FEW_VOTES) if len(words) < 1 << 15 else (24, _VOTES)
    total = sum([v for v in map(votes.get, words) if v])
    han = 0 if "".join(words).isascii() else sum([1 for w in words if "\u3400" <= w <= "\u9fff"])
    mask = (1 << bits) - 1
    return total & mask, total >> bits & mask, total >> 2 * bits & mask, total >> 3 * bits & mask, han // 2


def _romance(words: list[str]) -> int:
    """Over 0: endings rather Spanish than French; counts where the stopwords are the same in both."""
    return sum((w[-1] in "ao" or w.endswith(("ón", "or", "as", "os"))) - (w[-1] == "e" or w.endswith(("eau", "oir", "es", "eur", "et"))) for w in words if len(w) > 3)


def languages_of(words: list[str]) -> frozenset[str]:
    """The languages that get the most votes; none if there is no vote."""
    v = votes_of(words)
    top = max(v)
    if not top:
        return frozenset()
    best = [lang for lang, n in zip(_LANGS, v) if n == top]
    if best == ["fr", "es"]:
        tilt = _romance(words)
        best = ["es"] if tilt > 0 else ["fr"] if tilt < 0 else best
    return frozenset(best)


def foreign(query: str, query_langs: frozenset[str], words: list[str]) -> bool:
    """Is the entry, by a clear vote, in a language that is neither the query's nor asked for?"""
    if not query_langs:
        return False
    v = votes_of(words)
    first = max(v)
    at = v.index(first)
    lang = _LANGS[at]
    if lang in query_langs or first < 2 or first < 1.3 * max(v[:at] + v[at + 1 :]):
        return False
    if max((v[_LANGS.index(q)] for q in query_langs), default=0) * 1.5 >= first:
        return False
    return not _REQUESTED[lang].search(query)


class RefusalAutomaton:
    """All refusing phrases and courtesies at once (Aho-Corasick)."""

    def __init__(self) -> None:
        import ahocorasick

        self.find = ahocorasick.Automaton()
        for phrases, kind in ((COURTESIES, 1), (REFUSALS, 2)):
            for p in phrases:
                if p:
                    self.find.add_word(p, kind)
        self.find.make_automaton()

    def refuses(self, text: str, low: str) -> bool:
        """Does some sentence refuse, and every other one only surround that? low: the text in lower case."""
        if all(k != 2 for _, k in self.find.iter(" ".join(low.split()))):
            return False
        lines = text.split("\n")
        if len(lines) > 2 and len(_WORD.findall(text)) < WRAPPED * len(lines):
            text = " ".join(lines)
        for s in _SENTENCE.split(text):
            s = " ".join(s.lower().split())
            words = words_in(s)
            if len(words) > 1 and (sum(0.5 if _HAN.match(w) else 1 for w in words) > LONGEST_REFUSAL or next(self.find.iter(s), None) is None):
                return False
        return True


class EndModel:
    """How often sentences end after a context of words; rare words (names, numbers) are masked."""

    def __init__(self, texts: list[str], complete: list[str]):
        """texts: entries, whose last words tell nothing if no mark follows; complete: queries, which end where they end."""
        cut = [_TOKEN.findall(clean(t)) for t in texts]
        n_texts = len(cut)
        cut += [_TOKEN.findall(clean(t)) for t in complete]
        words = Counter(w.lower() for t in cut for w, _ in t)
        self._name(words)
        n: Counter = Counter()
        ends: Counter = Counter()
        self.whole = {w for w, k in Counter(re.sub(r"\s+", " ", t).strip().casefold() for t in texts if len(t) < 60).items() if k >= 3}
        for k_text, t in enumerate(cut):
            masked = [self.mask(w) for w, _ in t]
            for i, (_, gap) in enumerate(t):
                end = bool(_END.search(gap) or _BULLET.search(gap)) if gap else False
                if i + 1 == len(t) and not end:
                    if k_text < n_texts:
                        continue
                    end = True
                for k in range(1, min(CONTEXT, i + 1) + 1):
                    c = " ".join(masked[i + 1 - k : i + 1])
                    n[c] += 1
                    if end:
                        ends[c] += 1
        self.stats = {c: (m, ends[c]) for c, m in n.items() if m >= LEAST}
        #: Pairs of words in which some sentence ends, and the words that follow a word.
        self.last_pairs = {c for c in ends if c.count(" ") == 1}
        self.after: dict[str, set[str]] = {}
        for c in n:
            if c.count(" ") == 1:
                first, second = c.split(" ")
                self.after.setdefault(first, set()).add(second)

    @classmethod
    def counted(cls, words: dict[str, float], whole: set[str], contexts: list[tuple[str, float, float]]) -> EndModel:
        """From counts for PER_ROWS records: words, short texts that repeat, contexts (words, cases, ends)."""
        model = cls([], [])
        model._name(words)
        model.whole = whole
        model.stats = {c: (n, e) for c, n, e in contexts if n >= LEAST}
        model.last_pairs = {c for c, _, e in contexts if e >= 1 and c.count(" ") == 1}
        for c, n, _ in contexts:
            if n >= 1 and c.count(" ") == 1:
                first, second = c.split(" ")
                model.after.setdefault(first, set()).add(second)
        return model

    def _name(self, words: dict[str, float]) -> None:
        self.known = {w for w, n in words.items() if n >= LEAST + 2}
        self.seen = {w for w, n in words.items() if n >= (3 if len(w) > 2 else 50)}
        self.prefixes = {w[:i] for w in self.known if len(w) > 3 for i in range(1, len(w))}

    def mask(self, word: str) -> str:
        low = word.lower()
        return "#" if low[0].isdigit() else low if low in self.known or low in RARELY_LAST else "§"

    def share(self, words: list[str]) -> float | None:
        """The share of ends after these words: each longer context corrects the shorter one by its number of cases."""
        masked = [self.mask(w) for w in words[-CONTEXT:]]
        share = None
        for k in range(1, len(masked) + 1):
            s = self.stats.get(" ".join(masked[-k:]))
            if s is None:
                break
            if masked[-k:] != ["§"]:
                share = s[1] / s[0] if share is None else (s[1] + SMOOTH * share) / (s[0] + SMOOTH)
        return share


def _open(text: str) -> bool:
    """Does a delimiter that was opened stay open? Stray closers (as in a)) are passed over."""
    stack: list[str] = []
    for c in text:
        if c in _OPENERS:
            stack.append(c)
        elif c in _CLOSERS and stack and _CLOSERS[c] in stack:
            while stack.pop() != _CLOSERS[c]:
                pass
    return bool(stack)


def is_code(text: str) -> bool:
    return bool(_CODE.search(text))


def truncated(text: str, query_words: list[str], model: EndModel) -> bool:
    """text: cleaned. Does it break off?"""
    s = text.rstrip(_TRAILING)
    if s and s[-1] in ".!?。！？" and s[-2:] != "..":
        return False
    s = _BEFORE.sub("", text)
    while not s[-1:].isalpha() and (t := _AFTER.sub("", s).rstrip(" \t\n\u00a0\u3000")) != s:
        if s[len(t) :].strip().lower().startswith("etc"):
            return False
        s = t
    if not s:
        return False
    if is_code(s):
        return _open(s) or bool(_CODE_HANGING.search(s))
    trailing = _ELLIPSIS.search(s)
    if trailing:
        s = s[: trailing.start()].rstrip()
        if s and s[-1] in ",;，、；：:":
            return True
    # Quotes and brackets around the whole.
    core = s.rstrip("\"'”’»)]*_ \n")
    if core and core[-1] in ".!?。！？":
        return False
    if _HANGING.search(s):
        return True
    tokens = tokens_in(core)[0]
    if _open(s) and len(tokens) > 3:
        return True
    if not tokens:
        return False
    if re.sub(r"\s+", " ", s).strip().casefold() in model.whole:
        return False
    last = tokens[-1].lower()
    if last in HANGING_WORDS and len(tokens) > 1:
        return True
    if len(tokens) <= (LABEL_CHARS if _HAN.match(last) else LABEL_WORDS):
        return False
    if last not in model.seen and not last[0].isdigit():
        if len(last) > 1 and any(q.startswith(last) and q != last and len(q) > 5 for q in query_words):
            return True  # a name of the query, cut
        if last not in query_words and last in model.prefixes:
            return True
    share = model.share(tokens)
    if s.endswith(JOINING):
        return True
    pair = " ".join(model.mask(w) for w in tokens[-2:])
    if pair not in model.last_pairs and (share is None or share < SELDOM):
        if last in RARELY_LAST:
            return True
        follow = model.after.get(model.mask(tokens[-2]), ())
        if len(last) > 1 and not _HAN.match(last) and model.mask(last) not in follow and any(w.startswith(last) for w in follow):
            return True  # a word that is cut, and reads as another one
    if share is None:
        return False
    if trailing:
        return share <= 0.5
    if last in _VOTES or _HAN.match(last):
        return share <= NEVER
    if len(_ITEM.findall(text)) > 1 and not _END.search(text):
        return False  # a list whose items have no marks: they may end in any word of content
    return share <= NEVER / 3 and model.stats.get(model.mask(last), (0, 0))[0] >= LEAST_CONTENT


def _judge(model: EndModel):
    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        refusals = RefusalAutomaton()
        for batch in batches:
            out: list[tuple[int, str, int, str]] = []
            for rec, query, pos, neg, cls in zip(batch["rec_id"].tolist(), batch["query"].tolist(), batch["pos"].tolist(), batch["neg"].tolist(), batch["cls"].tolist()):
                if not has_text(query):
                    continue
                if pos is None or not len(pos):
                    out.append((rec, "pos", 0, "empty"))
                query_words: list[str] | None = None
                for side, entries in (("pos", pos), ("neg", neg)):
                    for i, text in enumerate(entries if entries is not None else ()):
                        if is_empty(text):
                            out.append((rec, side, i, "empty"))
                            continue
                        if cls:
                            continue
                        if query_words is None:
                            q = clean(query)
                            query_words = words_in(q.lower())
                            langs, automaton = languages_of(query_words), {}
                        t = clean(text)
                        low = t.lower()
                        words = words_in(low)
                        if refusals.refuses(t, low):
                            defect = "refusal"
                        elif is_copy(query_words, words, automaton):
                            defect = "copy"
                        elif foreign(q, langs, words) and not is_code(t):
                            defect = "language"
                        elif truncated(t, query_words, model):
                            defect = "truncated"
                        else:
                            continue
                        out.append((rec, side, i, defect))
            yield pd.DataFrame(out, columns=["rec_id", "side", "item_no", "defect"])

    return judge


def _hash(word: str) -> int:
    """Of a masked word; 0 is none."""
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little", signed=True) or 1


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of words and of short texts (kind w, t), and parts of the texts (kind a): the hashes of a part's words, where each stands, and marks of ends.

    Each text comes after a 0. A mark is 1 where a sentence ends, 2 where a text breaks off, so that nothing is known. A part
    is of whole records and about PART words, which is no large object to the JVM.
    """
    class Numbers(dict):
        def __missing__(self, w: str) -> int:
            self[w] = n = len(self)
            lows.append(low := w.lower())
            codes.append(_hash("#" if low[0].isdigit() else low))
            return n

    class Ends(dict):
        def __missing__(self, gap: str) -> int:
            self[gap] = end = int(bool(_END.search(gap) or _BULLET.search(gap)))
            return end

    # The number of each spelling, from 1; 0 is the place before a text.
    lows, codes, numbers, gaps = [""], [0], Numbers({"": 0}), Ends()
    counts: Counter = Counter()
    short: Counter = Counter()
    found, marks, rows = [], bytearray(), 0

    def told(counter: Counter, kind: str) -> pd.DataFrame:
        out = pd.DataFrame({"kind": kind, "word": list(counter), "n": list(counter.values()), "hashes": None, "places": None, "marks": None}, dtype=object)
        counter.clear()
        return out

    def part() -> tuple[int, bytes, bytes, bytes]:
        at = np.array(found, dtype=np.int64)
        n = np.bincount(at)
        some = np.flatnonzero(n).tolist()
        for i, k in zip(some, n[some].tolist()):
            if i:
                counts[lows[i]] += k
        place = (np.cumsum(n > 0) - 1)[at].astype(np.uint16 if len(some) <= 1 << 16 else np.uint32)
        return rows, np.array([codes[i] for i in some], dtype=np.int64).tobytes(), place.tobytes(), bytes(marks)

    for b in batches:
        parts = []
        for query, texts in zip(b["query"].tolist(), b["texts"].tolist()):
            for k, t in enumerate([query, *texts]):
                if not isinstance(t, str) or not t:
                    continue
                found.append(0)
                marks.append(2)
                if k and len(t) < 60:
                    short[re.sub(r"\s+", " ", t).strip().casefold()] += 1
                own, after = tokens_in(clean(t))
                if own:
                    found += map(numbers.__getitem__, own)
                    marks += bytes(map(gaps.__getitem__, after))
                    if not marks[-1]:
                        marks[-1] = 2 if k else 1
            rows += 1
            if len(found) >= PART:
                parts.append(part())
                found, marks, rows = [], bytearray(), 0
        if rows:
            parts.append(part())
            found, marks, rows = [], bytearray(), 0
        yield pd.DataFrame({"kind": "a", "word": None, "n": [x[0] for x in parts], "hashes": [x[1] for x in parts], "places": [x[2] for x in parts], "marks": [x[3] for x in parts]}, dtype=object)
        for counter, kind in ((counts, "w"), (short, "t")):
            if len(counter) > 100_000:
                yield told(counter, kind)
        if len(numbers) > 200_000 or len(gaps) > 200_000:
            lows, codes, numbers, gaps = [""], [0], Numbers({"": 0}), Ends()
    yield told(counts, "w")
    yield told(short, "t")


def _parts(batches: Iterator[pd.DataFrame], codes: np.ndarray, ids: np.ndarray, strange: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(records, ids of words, marks) of each part. codes: ascending hashes of words that have an id of their own; 0 has -1."""
    for b in batches:
        for n, h, p, m in zip(b["n"], b["hashes"], b["places"], b["marks"]):
            if not m:
                yield n, np.empty(0, dtype=np.int32), np.empty(0, dtype=np.uint8)
                continue
            h = np.frombuffer(h, dtype=np.int64)
            at = np.minimum(np.searchsorted(codes, h), len(codes) - 1)
            own = np.where(h == 0, -1, np.where(codes[at] == h, ids[at], strange)).astype(np.int32)
            yield n, own[np.frombuffer(p, dtype=np.uint16 if len(p) == 2 * len(m) else np.uint32)], np.frombuffer(m, dtype=np.uint8)


def _pieces(batches: Iterator[pd.DataFrame], codes: np.ndarray, ids: np.ndarray, strange: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Parts joined to pieces of about PIECE words."""
    held, rows, size, last = [], 0, 0, None

    def joined() -> tuple[int, np.ndarray, np.ndarray]:
        return rows, np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])

    for n, word, marks in _parts(batches, codes, ids, strange):
        held.append((word, marks))
        rows, size = rows + n, size + len(marks)
        if size >= PIECE:
            if last is not None:
                yield last
            last = joined()
            held, rows, size = [], 0, 0
    if size:  # a small piece would take rare contexts for frequent ones
        if last is not None:
            held.insert(0, last[1:])
            rows += last[0]
        last = joined()
        held = []
    if last is not None:
        yield last


def _mixed(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of contexts that go on with a word."""
    x = (h ^ (word + 1).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _longer(h: np.ndarray, at: np.ndarray, k: int, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts of k words that end at places `at`, from those of k - 1 words there: (hashes, places); none goes beyond a text. Overwrites both."""
    size = 0
    for i in range(0, len(at), PART):
        end = at[i : i + PART]
        first = word[np.maximum(end - (k - 1), 0)]
        inside = (first >= 0) & (end >= k - 1)
        end = end[inside]
        h[size : size + len(end)] = _mixed(h[i : i + PART][inside], first[inside])
        at[size : size + len(end)] = end
        size += len(end)
    return h[:size], at[:size]


def _frequent(batches: Iterator[pd.DataFrame], codes: np.ndarray, ids: np.ndarray, strange: int, once: float) -> Iterator[pd.DataFrame]:
    """(k, h, ids) of the contexts that are frequent in a piece; once: the cases for each record of it that count as one.

    Beside a piece it holds a place and a hash for each word; what is counted is a sixteenth of the contexts at a time.
    """
    for rows, word, marks in _pieces(batches, codes, ids, strange):
        least = np.array([LEAST, 1]) * once * rows * (1 - 1e-9)
        known = marks != 2
        n = np.bincount(word[known], minlength=len(codes) + 1)  # of single words, by their own ids
        good = n >= least[0]
        at = np.flatnonzero(known & good[word]).astype(np.int32)
        del marks, known
        one = _mixed(np.zeros(len(n), dtype=np.uint64), np.arange(len(n)))
        yield pd.DataFrame({"k": 1, "h": one[good].view(np.int64), "ids": [x.tobytes() for x in np.flatnonzero(good).astype(np.int32)]})
        h = one[word[at]]
        for k in range(2, CONTEXT + 1):
            h, at = _longer(h, at, k, word)
            slot, keep, told = (h >> np.uint64(60)).astype(np.uint8), np.zeros(len(h), dtype=bool), []
            for s in range(16):
                if not len(some := np.flatnonzero(slot == s)):
                    continue
                x = h[some]
                order = np.argsort(x)
                x, some = x[order], some[order]
                first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
                n = np.diff(first, append=len(x))
                good = first[n >= least[int(k == 2)]]
                where = at[some[good]][:, None] - np.arange(k)[::-1]
                told.append(pd.DataFrame({"k": k, "h": x[good].view(np.int64), "ids": [w.tobytes() for w in word[where].astype(np.int32)]}))
                keep[some] = np.repeat(n >= least[0], n)
            if not told:
                break
            yield pd.concat(told)
            h, at = h[keep], at[keep]


class _Places:
    """Of hashes in an ascending array: by their leading bits, which only a few have in common."""

    def __init__(self, hashes: np.ndarray):
        bits = max(8, len(hashes).bit_length() + 3)
        self.hashes, self.shift = hashes, np.uint64(64 - bits)
        self.first = np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.most = int(np.diff(self.first, append=len(hashes)).max())

    def of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, whether they hold these hashes)"""
        place = np.minimum(self.first[(h >> self.shift).view(np.int64)], len(self.hashes) - 1)
        at = self.hashes[place]
        for _ in range(self.most - 1):
            place = np.minimum(place + (at < h), len(self.hashes) - 1)
            at = self.hashes[place]
        return place, at == h


def _counted(batches: Iterator[pd.DataFrame], codes: np.ndarray, ids: np.ndarray, strange: int, asked: dict[int, np.ndarray]) -> Iterator[pd.DataFrame]:
    """(k, h, n, e): cases and ends of the contexts whose hashes are asked for, by the number of their words, ascending."""
    n, e = ({k: np.zeros(len(x), dtype=np.int64) for k, x in asked.items()} for _ in range(2))
    places = {k: _Places(x) for k, x in asked.items() if len(x)}
    for _, word, marks in _parts(batches, codes, ids, strange):
        at = np.flatnonzero(marks != 2)
        h = np.zeros(len(at), dtype=np.uint64)
        for k in range(1, CONTEXT + 1):
            h, at = _longer(h, at, k, word)
            if not len(asked[k]):
                break
            place, got = places[k].of(h)
            h, at, place = h[got], at[got], place[got]
            n[k] += np.bincount(place, minlength=len(asked[k]))
            e[k] += np.bincount(place[marks[at] == 1], minlength=len(asked[k]))
    for k, x in asked.items():
        some = np.flatnonzero(n[k])
        yield pd.DataFrame({"k": k, "h": x[some].view(np.int64), "n": n[k][some], "e": e[k][some]})


def fit_ends(records: DataFrame) -> EndModel:
    """The model of sentence ends, from all records.

    Words are counted first, then contexts of masked words: those that are frequent in some piece of the records, of which
    there is none that is frequent in all and in no piece, are counted in all pieces. So the driver and the executors hold
    what is frequent, whose number the thresholds bound, and no context that is rare is shuffled.
    """
    spark = records.sparkSession
    entries = F.filter(F.concat(F.coalesce("pos", F.array()), F.coalesce("neg", F.array())), lambda x: x.isNotNull())
    read = spread(records.select("query", entries.alias("texts"))).mapInPandas(_words, "kind STRING, word STRING, n BIGINT, hashes BINARY, places BINARY, marks BINARY")
    read = staged(read, f"{work_dir(spark)}/words")
    arrays = read.filter("kind = 'a'").select("n", "hashes", "places", "marks")
    total, size = arrays.agg(F.sum("n"), F.sum(F.octet_length("marks"))).first()
    if not total:
        return EndModel([], [])
    arrays = arrays.coalesce(-(-size // PIECE) or 1)
    scale = max(1.0, total / PER_ROWS)
    often = read.filter("kind <> 'a'").groupBy("kind", "word").agg(F.sum("n").alias("n")).filter(F.col("n") >= 3 * scale).collect()  # bounded by the words of PER_ROWS records
    words = {r.word: r.n / scale for r in often if r.kind == "w"}
    names = ["#", "§", *sorted(w for w in {w for w, n in words.items() if n >= LEAST + 2} | RARELY_LAST if not w[0].isdigit())]
    own = sorted((_hash(w), i) for i, w in enumerate(names) if i != 1)
    codes, ids = np.array([h for h, _ in own], dtype=np.int64), np.array([i for _, i in own], dtype=np.int64)

    found = arrays.mapInPandas(lambda b: _frequent(b, codes, ids, 1, scale / total), "k INT, h BIGINT, ids BINARY").dropDuplicates(["k", "h"]).toArrow()  # bounded by the thresholds
    of, hashes = found["k"].to_numpy(), found["h"].to_numpy()
    asked = {k: np.sort(hashes[of == k].view(np.uint64)) for k in range(1, CONTEXT + 1)}

    sums = arrays.mapInPandas(lambda b: _counted(b, codes, ids, 1, asked), "k INT, h BIGINT, n BIGINT, e BIGINT").groupBy("k", "h").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
    sums = sums.filter(F.col("n") >= F.when(F.col("k") == 2, 1).otherwise(LEAST) * F.lit(scale)).toArrow()
    place = {x: i for i, x in enumerate(zip(of.tolist(), hashes.tolist()))}
    contexts = []
    for k, h, n, e in zip(*(sums[c].to_pylist() for c in ("k", "h", "n", "e"))):
        words_of = np.frombuffer(found["ids"][place[k, h]].as_py(), dtype=np.int32)
        contexts.append((" ".join(names[i] for i in words_of), n / scale, e / scale))
    return EndModel.counted(words, {r.word for r in often if r.kind == "t"}, contexts)


def find_defects(records: DataFrame, tasks: DataFrame) -> DataFrame:
    """(rec_id, side, item_no, defect) of records (rec_id, query, pos, neg, source); tasks: (source, tag)."""
    tags = tasks.filter(F.col("source").isNotNull()).groupBy("source").agg(F.max(F.col("tag") == "[CLS]").alias("cls"))
    if tags.count() > MAX_SOURCES:
        raise ValueError(f"the task table names more than {MAX_SOURCES} sources")
    model = fit_ends(records)
    rows = spread(records.select("rec_id", "query", "pos", "neg", "source")).join(F.broadcast(tags), "source", "left")
    return rows.select("rec_id", "query", "pos", "neg", F.coalesce("cls", F.lit(False)).alias("cls")).mapInPandas(
        _judge(model), "rec_id BIGINT, side STRING, item_no INT, defect STRING"
    ).withColumn("item_no", F.col("item_no").cast("bigint"))
