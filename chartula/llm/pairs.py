"""Broken prompt and response pairs.

Copied wording is measured by running the response through a suffix automaton of the prompt's words; refusals are recognised by an automaton
over classes of words (who speaks, negation, ability, acts of answering, sources), so that wordings never seen before are found too; open
brackets and lists by a delimiter stack; the language by votes of frequent function words and of scripts.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import latest

#: Answers that say nothing, in lower case without punctuation.
NOTHING = ["", "null", "none", "nil", "nan", "n a", "na", "undefined", "no answer", "no response", "empty", "blank", "tbd", "todo", "a", "answer", "response", "output", "reply", "antwort", "réponse", "respuesta"]

#: Classes of words in sentences that decline. S speaks, N negates, M can or may, A answers, g gives (an answer), R what is asked for or given,
#: D declines, C sources, V what sources do, E enough, O outside, U covered, K knows.
WORDS_OF = {
    "S": "i we me us my our im je j nous moi suis peux puis pouvons dois devons ich wir mir uns mich yo nosotros puedo podemos estoy estamos tengo tenemos dispongo debo debemos io noi posso possiamo sono devo eu nós estou devemos podemos ik wij we kan jag vi",
    "N": "cannot not t never no nothing unable neither ne pas aucun aucune rien nicht kein keine keinen nichts ninguna ningún non nenhuma não niet geen inte",
    "M": "can could able may might will would permitted allowed authorised authorized position appropriate possible proper mesure autorisé autorisée possible permis kann können darf lage möglich befugt condiciones posible autorizado capaz grado possibile possível mogelijk staat möjligt",
    "A": "answer respond reply help assist comment discuss comply guess répondre aider commenter beantworten antworten helfen weiterhelfen äußern kommentieren responder contestar ayudar comentar rispondere aiutare responder ajudar antwoorden beantwoorden helpen svara hjälpa answers answering responding helping assisting commenting",
    "g": "give provide offer say share advise tell supply donner fournir dire proposer geben sagen erteilen nennen dar ofrecer decir facilitar proporcionar dare fornire dire dar fornecer dizer geven zeggen ge säga given offered provided",
    "R": "question questions request this that it topic matter matters subject response opinion advice information details réponse avis question sujet demande information cela ça frage auskunft stellungnahme angabe angaben dazu hierzu darauf rat thema anfrage respuesta opinión pregunta tema eso esto información risposta domanda opinione resposta pergunta antwoord vraag svar fråga",
    "D": "decline declining refuse declined decliner décliner refuse refuser ablehnen ablehne declinar rechazar rehusar declino rechazo rifiutare recusar weigeren",
    "C": "sources source documents document extracts extract passages passage context material materials text texts excerpts rulebook extraits documents sources passages contexte textes auszüge quellen unterlagen dokumente textstellen extractos fuentes documentos textos contexto estratti fonti documenti trechos fontes bronnen documenten källor",
    "V": "settle settles contain contains cover covers address addresses mention let lets allow allows permit permits say state specify permettent permet contiennent contient traitent abordent erlauben erlaubt lassen lässt enthalten enthält behandeln permiten permite contienen contiene tratan permettono permette contengono permitem contêm bevatten",
    "E": "enough sufficient insufficient assez suffisamment suffisantes genügend ausreichend ausreichende suficiente suficientes abbastanza sufficienti voldoende",
    "O": "outside beyond scope remit dehors außerhalb fuera ámbito",
    "U": "covered addressed answered stated mentioned discussed couvert abordé behandelt abgedeckt cubierto tratado",
    "K": "know idea sais weiß sé",
}
_CLASS = {w: c for c, ws in WORDS_OF.items() for w in ws.split()}
#: Sentences that decline, over the classes; '.' is a word of any class, 'x' one of none.
DECLINES = [
    r"S.{0,4}N.{0,4}A", r"N.?S.{0,5}A", r"S.{0,4}N.{0,5}g.{0,3}[RA]", r"N.?S.{0,5}g.{0,3}[RA]", r"S.{0,4}N.{0,2}R.{0,2}g",  # I cannot answer, give an answer
    r"S.{0,2}D(?:$|x?[AgR]|.{0,3}R)", r"^D(?:$|.{0,4}R)",  # I must decline
    r"C.{0,3}N.{0,3}V.{0,5}[AR]", r"N.{0,3}C.{0,3}V.{0,3}A", r"C.{0,3}V.{0,2}N.{0,3}[AR]",  # the sources do not settle this
    r"^N[AR].{0,4}[MgA]", r"^.{0,2}NA.{0,2}M",  # no answer can be given
    r"N.{0,2}M.{0,3}S.{0,3}[Ag]", r"^.{0,3}N.{0,2}M.{0,2}A", r"^RM.{0,2}N.{0,2}A",  # it is not possible to answer
    r"S.{0,3}N.{0,3}E.{0,2}R", r"N.{0,2}E.{0,2}R.{0,3}A", r"^.{0,2}ER.{0,3}A",  # not enough information to answer
    r"O.{0,3}S.{0,4}[AMO]", r"O.{0,2}S(?:$|x)", r"SO(?:$|x)", r"^R.{0,3}OS",  # outside what I may discuss
    r"^(?:Rx)?NU.{0,2}[CR]", r"^N.{0,1}U(?:$|x?x?C)",  # not covered by the sources
    r"S.{0,2}N.{0,2}K", r"S.{0,2}NK",  # I do not know
    r"^(?:sorry|x)?.{0,1}N.{0,1}A.{0,2}R",  # cannot help with that
]
#: Words of sentences that are courtesy, not an answer.
COURTESY = set("please thank thanks sorry apologies apologise apologize contact consult question questions enquiry enquiries unfortunately understand appreciate professional expert website helpdesk merci désolé veuillez question questions danke bitte leider frage fragen gracias lamento consulte pregunta preguntas grazie prego obrigado".split())

#: Frequent function words of each language.
STOPWORDS = {
    "en": "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were her all their there been if more when will would who so no can may shall must has within its any than what how many why where whose whom do does should could after before your our we under such other only these those i me my".split(),
    "fr": "le la les de des du un une et en est que qui dans pour sur au aux avec par ce cette ces il elle ils ne pas plus se sa son ses leur leurs ou où mais si sans sous entre après avant chaque dont être été sont cela doit même dès lors tout toute tous lorsque quand combien pourquoi quel quelle comment aucun aucune je vous nous afin ainsi jusqu jusque".split(),
    "de": "der die das den dem des ein eine einer eines einem einen und ist im in zu zum zur von vom mit für auf nicht auch sich als wie bei nach aus oder aber wenn dass daß werden wird wurde sind hat haben kann muss dies diese dieser dieses es er sie ich wir ihr um vor über unter durch ohne sofern falls sobald innerhalb keine kein nichts jeder jede jedem wer wie warum welche welcher gilt obwohl bis".split(),
    "es": "el la los las de del un una unos unas y en es que por para con no se su sus lo al como más pero o si sin sobre entre tras antes después cada cuando quién cuál cuánto cuántos cómo porque aunque desde hasta este esta estos estas ese esa ha han ser son está debe puede también mismo todo toda todos le les yo me a haya hayan".split(),
    "it": "il lo la i gli le di del della dei delle dello un una uno e è in che per con non si suo sua al alla ai come più ma o se senza su tra dopo prima ogni quando chi perché questo questa essere sono ha hanno deve può anche entro da dal dalla nel nella".split(),
    "pt": "o a os as de do da dos das um uma e é em que por para com não se seu sua ao à aos como mais mas ou sem sobre entre após antes cada quando quem porque este esta ser são tem têm deve pode também no na nos nas pelo pela".split(),
    "nl": "de het een en van in is dat die voor op met niet te aan er zijn of door als bij naar uit om maar dan wordt worden heeft hebben kan moet deze dit geen binnen wie waarom welke hoe ook tot onder".split(),
    "sv": "och att det som en ett är i på av för med den till inte om har de kan ska måste inom när vem varför vilken hur från eller vid efter innan även utan under sin sitt".split(),
    "da": "og at det som en et er i på af for med den til ikke om har de kan skal inden når hvem hvorfor hvilken hvordan fra eller ved efter før også uden".split(),
    "pl": "i w z na do nie że się jest to od po za o jak dla przez są który która które oraz może musi być czy lub przed bez pod gdy tego".split(),
}
_VOTES: dict[str, list[str]] = {}
for _lang, _words in STOPWORDS.items():
    for _w in dict.fromkeys(_words):
        _VOTES.setdefault(_w, []).append(_lang)
#: Scripts that tell a language, or a family of them, by the name of their letters.
SCRIPTS = {"HIRAGANA": "ja", "KATAKANA": "ja", "CJK": "zh", "HANGUL": "ko", "CYRILLIC": "cyrillic", "GREEK": "el", "ARABIC": "ar", "HEBREW": "he", "DEVANAGARI": "hi", "THAI": "th", "BENGALI": "bn", "TAMIL": "ta"}

_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"<[^<>]*>")
_CITE = re.compile(r"[\[(]\s*S?\d+(?:\s*[,;]\s*S?\d+)*\s*[\])]", re.I)
_LABEL = re.compile(r"^\W*(?:question|answer|response|reply|frage|antwort|réponse|pregunta|respuesta|q|a)\s*:\s*", re.I)
_QUOTED = re.compile(r"“[^”]*”|„[^“”]*[“”]|«[^»]*»|\"[^\"]*\"")
_SENTENCE = re.compile(r"(?<=[.!?…])[\s\"'”»)]+")
_MARKER = re.compile(r"^\s*(?:\(?([a-z]|[ivx]+|\d+)[).]|[-*•])\s+", re.I)
_CLOSED = re.compile(r"(?:[.!?…。！？।؟]|\d\s?[%€£$₹])[\"'”’»)\]*_」』]*$")
#: Words no complete sentence ends with.
_DANGLING = set("a an the of to in and or nor by for from with at on under within between that which who whose if when where unless until than as any no every is are was were be been shall may has have its their de la le les des du un une et en dans par pour sur der die das den dem des ein eine und von mit im zu für el los las del y con por para que".split())
COPIED, RUN = 0.8, 3
#: Words that are neither refusal nor courtesy which a refusal may hold; with more it is an answer with a reservation.
BESIDE = 20
#: Words that open or carry a clause: a short answer with one of them is no mere name or figure, so it must end like a sentence.
_CLAUSE = set("shall must may will has have had is are was were by where when if every which that who whether unless exceeding referred guaranteed doit peut est sont wird werden ist sind hat debe puede es son".split())
SHORT, NAME_WORDS = 5, 12
_ARTICLES = set("the a an any each every its his her their this le la les un une l der die das den dem ein eine einen el los las una".split())
_LINKS = set("of to in for by with from at on under and or as de à des du et pour par von für mit und zu y con por para en".split())


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class SuffixAutomaton:
    """Suffix automaton of a word sequence: recognises each of its runs of consecutive words."""

    def __init__(self, seq: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for w in seq:
            cur = self._new(self.length[last] + 1)
            p = last
            while p != -1 and w not in self.next[p]:
                self.next[p][w] = cur
                p = self.link[p]
            if p == -1:
                self.link[cur] = 0
            else:
                q = self.next[p][w]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    copy = self._new(self.length[p] + 1)
                    self.next[copy], self.link[copy] = dict(self.next[q]), self.link[q]
                    while p != -1 and self.next[p].get(w) == q:
                        self.next[p][w] = copy
                        p = self.link[p]
                    self.link[q] = self.link[cur] = copy
            last = cur

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def covered(self, seq: list[str], run: int) -> int:
        """Words of ``seq`` that lie in a run of at least ``run`` words of the automaton's sequence."""
        at = long = total = done = 0
        for i, w in enumerate(seq):
            while at and w not in self.next[at]:
                at = self.link[at]
                long = self.length[at]
            if w in self.next[at]:
                at, long = self.next[at][w], long + 1
            if long >= run:
                total += min(long, i + 1 - done)
                done = i + 1
        return total


@lru_cache(4096)
def _prompt(question: str) -> tuple[SuffixAutomaton, int]:
    seq = words(question)
    return SuffixAutomaton(seq), len(seq)


_DECLINES = re.compile("|".join(DECLINES))


def declines(sentence: str) -> bool:
    """Whether a sentence declines to answer: its words as a string of classes, run through the automaton of ``DECLINES``."""
    seq = words(sentence)
    return bool(_DECLINES.search("".join(_CLASS.get(w, "x") for w in seq)))


def votes(text: str) -> dict[str, float]:
    """Votes of function words for languages, a word of several counting for each; two letters of a script that tells its language give one."""
    out: Counter = Counter()
    for w in words(text):
        if w in _VOTES:
            for lang in _VOTES[w]:
                out[lang] += 1
        elif not w.isascii():
            for ch in w:
                if ch > "\u036f":
                    script = SCRIPTS.get(unicodedata.name(ch, "").split(" ")[0])
                    if script:
                        out[script] += 0.5
    if out["ja"]:  # Han letters stand in Japanese texts too
        out["ja"] += out.pop("zh", 0)
    return out


def other_language(question: str, answer: str) -> bool:
    """Whether the answer is in a language the question may not be in: it has two votes or more for it, and clearly more than for any the question may be in."""
    asked, said = votes(question), votes(answer)
    top = max(asked.values(), default=0)
    if top < 1.5:
        return False
    own = {lang for lang, v in asked.items() if v >= (top - 0.25) / 1.25}
    best = max((v for lang, v in said.items() if lang not in own), default=0)
    return best >= 1.5 and best >= 1.25 * max((said.get(lang, 0) for lang in own), default=0) + 0.25


def open_delimiters(text: str) -> list[str]:
    """Brackets and paired quotes still open at the end; a closing mark without an opening one (``a)``) is ignored."""
    pairs = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}
    stack: list[str] = []
    for ch in text:
        if ch in "([{“«":
            stack.append(ch)
        elif ch in pairs and pairs[ch] in stack:
            while stack and stack.pop() != pairs[ch]:
                pass
    return stack


def _core(answer: str) -> str:
    """The answer without markup, labels and citations."""
    text = _TAG.sub(" ", answer)
    text = _CITE.sub(" ", text)
    return _LABEL.sub("", text).strip()


def names_something(text: str, seq: list[str]) -> bool:
    """A short answer that is a name or a figure needs no full stop: one sentence without a word that carries a clause, in which an article stands
    at the start or after a linking word only (elsewhere it follows a verb)."""
    if len(_SENTENCE.split(text)) > 1 or len(seq) > NAME_WORDS or _CLAUSE & set(seq) or len(seq) > SHORT and seq[0] in _LINKS:
        return False
    return len(seq) <= SHORT or all(i == 0 or w not in _ARTICLES or seq[i - 1] in _LINKS for i, w in enumerate(seq))


def breaks_off(answer: str) -> bool:
    cited = bool(re.search(r"[\[(]\s*S?\d+(?:\s*[,;]\s*S?\d+)*\s*[\])]\W*$", answer.rstrip(), re.I))
    text = re.sub(r"[*_`\s]+$", "", _TAG.sub(" ", _CITE.sub(" ", answer)))
    if not text:
        return False
    if open_delimiters(text):
        return True
    seq = words(text)
    lines = [x for x in text.splitlines() if x.strip()]
    if len(lines) > 1 and re.fullmatch(r"\(?(?:[a-z]|[ivx]+|\d+)[).]|[-*•]", lines[-1].strip(), re.I):  # a list marker without its item
        return True
    if _CLOSED.search(text):
        return False
    if re.search(r"[,;:(\[{\-–—/&]$", text) or (len(seq) > 2 and seq[-1] in _DANGLING):
        return True
    if cited or len(lines) == 1 and names_something(text, seq):
        return False
    if len(lines) > 1 and all(_MARKER.match(x) for x in lines) and all(re.search(r"[;,.]\s*(?:and|or|und|et|y|ou|o|oder)?\s*$", x) for x in lines[:-1]):
        # a list without a full stop: its last item is whole if it is no shorter than half of the shortest other one
        sizes = [len(words(x)) for x in lines]
        return 2 * sizes[-1] < min(sizes[:-1])
    return True


def defect(question: str | None, answer: str | None, kind: str | None) -> str | None:
    """'empty', 'echo', 'refusal', 'language', 'truncated' or null, tested in this order.

    A null or blank answer is empty; without a question neither echo nor language can be told. ``kind`` 'unanswerable' allows refusals.
    """
    if answer is None:
        return "empty"
    core = _core(answer)
    seq = words(core)
    if " ".join(seq) in NOTHING:
        return "empty"
    if question and question.strip():
        automaton, n = _prompt(re.sub(r"\s+", " ", question.strip()))
        if n and 2 * len(seq) >= n and automaton.covered(seq, RUN) >= COPIED * len(seq):
            return "echo"
    sentences = [s for s in _SENTENCE.split(core) if s.strip()]
    no = [s for s in sentences if declines(s)]
    content = [s for s in sentences if s not in no and not COURTESY & set(words(s))]
    if no and sum(len(words(s)) for s in content) <= BESIDE:
        return "truncated" if breaks_off(answer) and len(no) < len(sentences) else None if (kind or "").strip().lower() == "unanswerable" else "refusal"
    if question and other_language(question, _QUOTED.sub(" ", core)):
        return "language"
    return "truncated" if breaks_off(answer) else None


def broken_pairs(df: DataFrame, question: str = "question", answer: str = "system_answer", kind: str = "type") -> DataFrame:
    """``df`` with ``defect`` (null for sound pairs), computed in Arrow batches without a shuffle. A present ``defect`` column is replaced.

    The function counts as nondeterministic, so that a filter on its result is not computed a second time.
    """

    @F.pandas_udf("string")
    def find(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, a, k in parts:
            yield pd.Series([defect(*(None if x is None or x != x else x for x in row)) for row in zip(q, a, k)], dtype=object)

    return df.withColumn("defect", find.asNondeterministic()(question, answer, kind))


def current_verdicts(df: DataFrame) -> DataFrame:
    """Per (id, source_run) the row with the greatest ``run_at``."""
    return latest(df, ["id", "source_run"], "run_at", ["id", "source_run", "type", "question", "system_answer"])
