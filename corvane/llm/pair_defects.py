"""Broken question and answer pairs: empty, copied, refused, in another language, or cut off answers.

A suffix automaton of the question, walked along the answer, gives the share of the answer that is copied from it in long matches and the
share of the question the answer covers. Refusals are found by an automaton of phrases and must fill the answer; cut-off answers by stacks
of delimiters and the last words; the language by votes of stopwords on both sides, unless the question asks for a language.

A null answer is empty. A null or empty question can't be copied and has no language, so only the other defects are judged. One defect a
request: the first that holds of empty, copy, refusal, language, truncated. Requests logged again give one row; if their texts differ, the
latest one counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import flat_map

#: A match counts as copied from this many characters on.
MIN_MATCH = 6
#: Shares from which an answer only repeats its question.
ANSWER_COPIED, QUESTION_COVERED = 0.8, 0.5

# --- suffix automaton ---------------------------------------------------------------------------------------------------------------


class SuffixAutomaton:
    """Every substring of a text, in states linear in its length."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.end = [-1], [0], [0]
        last = 0
        for i, c in enumerate(text):
            cur = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            self.end.append(i + 1)
            p = last
            while p != -1 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p != -1:
                q = self.next[p][c]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    self.end.append(self.end[q])
                    while p != -1 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def coverage(self, other: str, least: int) -> tuple[int, int]:
        """Characters of other that lie in matches of at least `least`, and characters of the text those matches cover."""
        state = length = 0
        ends: list[tuple[int, int, int]] = []
        for i, c in enumerate(other):
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                length += 1
            if length >= least:
                if ends and ends[-1][0] == i and ends[-1][1] == length - 1:
                    ends.pop()
                ends.append((i + 1, length, self.end[state]))
        mine, theirs = set(), set()
        for e, n, at in ends:
            theirs.update(range(e - n, e))
            mine.update(range(at - n, at))
        return len(theirs), len(mine)


def _plain(text: str) -> str:
    return re.sub(r"[^\w]+", " ", text.lower()).strip()


def _hardly_copied(q: str, a: str) -> bool:
    """Whether more than the allowed share of the answer stands in no match of the question: then the automaton needn't be built."""
    allowed = (1 - ANSWER_COPIED) * len(a)
    bare = covered = 0
    for i in range(len(a) - MIN_MATCH + 1):
        if a[i : i + MIN_MATCH] in q:
            covered = i + MIN_MATCH
        elif i >= covered:
            bare += 1
            if bare > allowed:
                return True
    return False


def copied(question: str, answer: str) -> bool:
    """Whether the answer only repeats the question, however often."""
    q, a = _plain(question), _plain(answer)
    if not q or not a or _hardly_copied(q, a):
        return False
    theirs, mine = SuffixAutomaton(q).coverage(a, MIN_MATCH)
    return theirs >= ANSWER_COPIED * len(a) and mine >= QUESTION_COVERED * len(q)


# --- empty --------------------------------------------------------------------------------------------------------------------------

_NULL_WORD = re.compile(r"(?i)(?:none|null|nil|n/?a|nan|undefined|void|empty|no answer|not available|-+|tbd)")
_FENCE = re.compile(r"(?m)^\s*(?:```|~~~)[\w+-]*\s*$")


def empty(answer: str | None) -> bool:
    if answer is None:
        return True
    bare = _FENCE.sub("", answer)
    bare = re.sub(r"[\s​-‏⁠﻿­]+", " ", bare).strip()
    return not re.search(r"\w", bare) or _NULL_WORD.fullmatch(bare.strip(" .!()[]{}<>\"'`*_")) is not None


# --- refusal ------------------------------------------------------------------------------------------------------------------------

# Word classes of the refusal automaton: who speaks, what denies, what may be done or is allowed, what is said or given, verbs that decline,
# where a limit is drawn, what is lacking.
SELF, DENY, ABLE, SAY, DECLINE, LIMIT, LACK, ALLOW = (1 << i for i in range(8))
# Stems of the eight languages; a stem with a star matches every word that begins with it.
_STEMS = {
    SELF: "m'* estoy tengo puedo debo niego quiero prefiero estou tenho posso devo consigo prefiro sou jestem mam muszę sono ho devo могу вынужден i im i'm ive i'd i'll me my myself ich mir mich mein* je j j'ai me m moi mon mes mes yo mi mí me puedo podemos eu mim meu meus minha minhas me posso я мне меня мной мои мой моих мы ja mnie mi mój moje moich mną mogę io me mi mio miei posso",
    DENY: "not no cannot can't cant won't wont don't isn't wouldn't couldn't unable never nothing without nicht kein* nie nichts ohne ne n pas aucun* rien sans no ningun* ningún nunca nada sin não nao nenhum* nunca nada sem не нет никак* нельзя невозможно nie żaden żadn* nic non nessun* niente impossible unmöglich imposible impossível niemożliw* impossibile",
    ABLE: "can cannot can't cant could couldn't able unable will won't would wouldn't let lets may possible something kann könnte* darf möglich lage imstande lässt möchte werde peux puis pourrai* mesure possible impossible veux saurais puedo podré podría posible imposible condiciones capaz deja dejan quiero pienso posso poderei poderia consigo possível impossível condições quero могу можем смогу возможно невозможно состоянии буду стану хочу вправе право mogę możemy możliwe stanie będę chcę posso potrò possibile grado voglio position impossible préfère préférerais prefiero prefiro preferisco bevorzuge wolę предпочитаю нельзя prefer",
    ALLOW: "allow* permit* permiss* permiso* erlaubnis genehmigung pozwoleni* нельзя authori* licensed befugt berechtigt erlaub* gestatte* autorisiert zulässig darf autorisé* permis permise permet* permett* droit autoriz* permit* допуст* разреш* позвол* имею вправе права upoważnion* wolno uprawnion* pozwal* autorizzat* permess* concesso",
    SAY: "prononcer pronunci* auslassen opine* opinar высказыв* wypowiad* help assist assistance answer* respond* response reply discuss* talk* comment* provide* share say tell speak address advise elaborate disclose reveal comply fulfill fulfil that this look hilf* helfen weiterhelfen behilflich antwort* beantwort* auskunft sag* sprech* besprech* äußer* mitteil* eingehen diskutier* kommentier* stellung unterstütz* dienen aid* répon* aider parler dire discuter commenter fournir donner partager renseign* communiquer traiter ayud* respond* contest* hablar decir comentar discutir proporcionar compartir tratar ofrecer dar ajud* respond* falar dizer comentar discutir fornecer partilhar compartilhar tratar informar помо* ответ* отвеч* говорить сказать обсужда* обсудить комментир* предостав* рассказ* дать сообщ* pomóc pomoc odpowied* odpowiada* mówić powiedzieć omawia* omówić komentować udziel* podać aiut* rispond* parlare dire discutere commentare fornire",
    DECLINE: "decline refuse refusing declining pass ablehn* verweiger* lehne décliner refuser refuse décline rechaz* declin* negarme niego recus* declin* отказ* отклон* вынужден* odmaw* odmówić rifiut* declin*",
    LIMIT: "outside beyond scope guidelines policy policies instruct* rules restricted off-limits außerhalb richtlinien vorgaben regeln anweisung* rahmen hors dehors cadre consignes règles directives instructions fuera alcance normas instrucciones directrices fora âmbito normas instruções diretrizes regras вне пределами рамк* правил* инструкц* poza zakres* zasad* wytyczn* instrukcj* fuori ambito regole istruzioni",
    LACK: "enough context information access knowledge insight basis genug kontext informationen zugriff zugang einblick grundlage assez contexte informations accès suficiente* contexto información acceso informações acesso достаточно контекст* информаци* доступ* wystarczając* kontekst* informacji dostępu abbastanza contesto informazioni accesso",
}
# What makes a sentence refuse, as sets of classes that must all have been read.
_REFUSING = (SELF | DENY | ABLE | SAY, SELF | DENY | ALLOW, SELF | DENY | LACK | SAY, SELF | DECLINE, SELF | LIMIT | ALLOW, SELF | LIMIT | ABLE, SELF | LIMIT | DENY)
# Idioms that refuse though they lack one of the classes, in lower case with plain quotes.
_IDIOMS = (
    "as an ai", "as a language model", "i'd rather not", "i would rather not", "unable to assist", "unable to help", "unable to answer", "can't be of help", "cannot be of help", "i don't have access to", "not something i can", "i can't see my way",
    "tut mir leid", "je suis désolé", "je regrette", "lo siento", "lamento", "desculpe", "sinto muito", "к сожалению, я не", "извините", "простите, но", "przykro mi", "niestety nie",
)


class RefusalAutomaton:
    """A deterministic automaton over words: a state is the set of classes read so far, a refusing state holds one of the sets above.
    Transitions are made when they are first taken; there are at most 2**8 states and as many kinds of words."""

    def __init__(self) -> None:
        self.words: dict[str, int] = {}
        self.stems: list[dict[str, int]] = [{} for _ in range(16)]  # by length
        for kind, text in _STEMS.items():
            for w in text.split():
                table = self.stems[len(w) - 1] if w.endswith("*") else self.words
                w = w.rstrip("*")
                table[w] = table.get(w, 0) | kind
        self.refusing = [any(state & need == need for need in _REFUSING) for state in range(1 << 8)]
        self.idioms = ahocorasick.Automaton()
        for phrase in _IDIOMS:
            self.idioms.add_word(phrase, phrase)
        self.idioms.make_automaton()
        self.known: dict[str, int] = {}

    def kind(self, word: str) -> int:
        if (k := self.known.get(word)) is None:
            k = self.words.get(word, 0)
            for n in range(2, min(len(word), 15) + 1):
                k |= self.stems[n].get(word[:n], 0)
            if len(self.known) < 100_000:
                self.known[word] = k
        return k

    def refuses(self, sentence: str) -> bool:
        state = 0
        for w in _REFUSAL_WORD.findall(sentence):
            state |= self.kind(w)
            if w.endswith("n't"):
                state |= DENY
        return self.refusing[state] or any(True for _ in self.idioms.iter(sentence))


_REFUSAL_WORD = re.compile(r"[^\W\d_]+(?:['-][^\W\d_]+)*")


@lru_cache(maxsize=1)
def _refusals() -> RefusalAutomaton:
    return RefusalAutomaton()


# After one of these a refusing sentence goes on to answer.
_GOES_ON = re.compile(r"(?i)\b(?:but|yet|however|still)\b(?! i (?:can'?t|cannot|am|'m|must|have|won'?t|don'?t)\b)(?! ich | je | no puedo| não posso)|\b(?:aber|mais|pero|mas|no entanto|но|однако|ale)\b(?! (?:ich|je ne|no puedo|não posso|я не|nie))")
_OFFER = re.compile(r"(?i)\b(?:anything else|something else|another question|rephrase|contact|happy to help|let me know|please ask|please try|noch etwas|autre chose|algo más|outra coisa|mais alguma|что-нибудь ещё|understand|apologi[sz]e|i hope)\b")


_SAID = re.compile(r"```.*?(?:```|$)|`[^`]*`|\"[^\"]*\"|“[^”]*”|«[^»]*»", re.S)
_SAYS = re.compile("[`\"“«]")
_SENTENCES = re.compile(r"(?<=[.!?…])\s+|\n+")
_ANY_WORD = re.compile(r"\w+")
_SORRY_BUT = re.compile(r"(?i)^\W*(?:i'm |i am )?(?:so |very )?sorry,? but |désolé,? mais|lo siento,? pero|desculpe,? mas|извините,? но|leid,? aber")


def refused(answer: str) -> bool:
    text = answer.replace("’", "'").replace("ʼ", "'")
    bare = _SAID.sub(" ", text) if _SAYS.search(text) else text
    refusing, rest = 0, 0
    for sentence in _SENTENCES.split(bare):
        words = len(_ANY_WORD.findall(sentence))
        if not words:
            continue
        low = sentence.lower()
        if _refusals().refuses(low) and not _GOES_ON.search(_SORRY_BUT.sub("", low)):
            refusing += words
        elif not _OFFER.search(low) and not re.fullmatch(r"\W*(?:sorry|unfortunately|leider|désolé|perdón)\W*", low):
            rest += words
            if rest > 6:
                return False
    return refusing > 0


# --- language -----------------------------------------------------------------------------------------------------------------------

# Frequent words of each language.
_STOPWORDS = {
    "en": "the of and is to in that it for was on are with as his they be at one have this from or had by but some what there we can out other were all your when up use how said an each she which do their if will way about many then them would like so these her has see him into could no than first been its who now my made over did down only you why where before first not under here does the goes keeps comes otherwise once",
    "de": "der die das und ist in zu den mit von für auf nicht ein eine einer eines dem des sich als auch es an werden aus er hat dass sie nach wird bei um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei wir kann keine gibt wenn weil darf danach zuerst warum jede solange ich wo etwa lässt ist später können nach dem",
    "fr": "le la les de des du et est un une en que qui dans pour pas sur au aux avec ce cette ces il elle ne se sont par plus ou son sa ses mais nous vous leur être a à été comme tout y si où pourquoi comment peut doit chaque après avant d l n qu faut dès aucune ici lui dont très",
    "es": "el la los las de del y es un una en que por para con no se su al lo como más o pero sus le ya este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto mí antes algunos qué unos yo otro cada después cómo dónde debe está puede así tan",
    "pt": "o a os as de do da dos das e é um uma em no na nos nas que por para com não se seu sua ao como mais ou mas foi ele ela tem à já está eu também só pelo pela até isso entre era depois sem mesmo aos ter seus quem me esse eles você essa num nem suas meu às minha cada deve após onde pode então são uma seguro aqui onde",
    "ru": "и в не на я быть он с что а по это она этот к но они мы весь который из у то за свой от так о для ты же все тот мочь вы человек такой его сказать только или ещё бы себя один как уже до если нет при потому после нужно можно почему где когда может всё её их через сначала перед каждый каждую",
    "pl": "i w nie na się z do to że jest o a jak po co tak za od są przez dla ale czy tylko już go jego ich być ma przed może jeszcze ten ta te tym gdy teraz musi każdy można proszę dlaczego nowa trzeba ją jednocześnie później ponieważ",
    "it": "il lo la i gli le di e è un una in che per con non si su al come più o ma suo sono del della dei delle nel nella questo questa da ha anche dopo prima perché dove ogni deve può quando",
}
_STOPWORDS = {k: frozenset(v.split()) for k, v in _STOPWORDS.items()}
_MARKS = {"de": "äöüß", "fr": "èêëîïôûùœ’", "es": "ñ¿¡", "pt": "ãõ", "pl": "ąęłńśźż"}
# How a question asks for a language.
_ASKED = {
    "en": r"\b(?:in|into) english\b|auf englisch|en anglais|en inglés|em inglês|по-английски|на английском|po angielsku",
    "de": r"\b(?:in|into) german\b|auf deutsch|en allemand|en alemán|em alemão|по-немецки|на немецком",
    "fr": r"\b(?:in|into) french\b|auf französisch|en français|en francés|em francês|по-французски|на французском",
    "es": r"\b(?:in|into) spanish\b|auf spanisch|en espagnol|en español|em espanhol|по-испански|на испанском",
    "pt": r"\b(?:in|into) portuguese\b|auf portugiesisch|en portugais|en portugués|em português|по-португальски|на португальском",
    "ru": r"\b(?:in|into) russian\b|auf russisch|en russe|en ruso|em russo|по-русски|на русском",
    "pl": r"\b(?:in|into) polish\b|auf polnisch|en polonais|en polaco|em polonês|по-польски|po polsku",
    "it": r"\b(?:in|into) italian\b|auf italienisch|en italien|en italiano|em italiano|по-итальянски|in italiano",
}
_ANY_ASKED = re.compile("|".join(_ASKED.values()), re.I)
_ASKED = {k: re.compile(v, re.I) for k, v in _ASKED.items()}
_CODE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`|\"[^\"\n]*\"|\b\w*[_/\\]\w[\w/\\.:-]*|\b[\w-]+\.(?:py|js|ts|go|java|md)\b", re.S)
_LETTERS = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=50_000)
def _votes(word: str) -> tuple[str, ...]:
    """The languages a word speaks for: as a stopword, and by the letters in it."""
    marked = [lang for lang, marks in _MARKS.items() if any(m in word for m in marks)]
    return (*(lang for lang, stop in _STOPWORDS.items() if word in stop), *marked)


def language_of(text: str) -> tuple[str, float] | None:
    """The language with most votes and its lead over the next one; None if there are too few votes."""
    bare = _CODE.sub(" ", text)
    words = _LETTERS.findall(bare.lower())
    if not words:
        return None
    cyrillic = sum("Ѐ" <= w[0] <= "ӿ" for w in words)
    if cyrillic >= 2 and cyrillic >= 0.4 * len(words):
        return "ru", float(cyrillic)
    votes: Counter = Counter(dict.fromkeys(_STOPWORDS, 0))
    for w in words:
        for lang in _votes(w):
            votes[lang] += 1
    (first, n), (_, second) = votes.most_common(2)
    if n < 2 or n == second:
        return None
    return first, float(n - second)


def wrong_language(question: str, answer: str) -> bool:
    got = language_of(answer)
    if not got:
        return False
    asked = [k for k, p in _ASKED.items() if p.search(question)] if _ANY_ASKED.search(question) else []
    if got[0] in asked:
        return False
    want = language_of(question)
    return want is not None and want[0] != got[0] and got[1] >= 2 and want[1] >= 1


# --- truncated ----------------------------------------------------------------------------------------------------------------------

_DONE = re.compile(r"(?:[.!?…。！？]|```|~~~)[\"'”’»)\]*_`]*$")
_ITEM = re.compile(r"\s*(?:\d+[.)]|[-*•+])\s+")
_REFERENCE = re.compile(r"(?i)\s*(?:see|siehe|voir|ver|véase|veja|см\.?|in|at|from|file|line|dans|en|em|в)?:?\s*`?[\w./\\-]*[/\\.:][\w./\\:-]*`?\s*")
# Words no sentence ends with.
_OPEN_WORDS = frozenset(
    "the a an of and or to in with from by for at on when which that this these those as than then because if while where who whose each every into over under between is are was were be been has have had will would can could may must not no but so its their his her"
    " der die das und oder mit von für auf ein eine einen einem einer dem den des zu zum zur wenn weil dass durch bei"
    " le la les de des du et ou avec pour dans un une que qui par sur au aux dont quand"
    " el los las del y o con por para un una que en cuando donde"
    " os as do da dos das e com por para um uma em no na quando onde"
    " и в на с по из от для что который когда где или через".split()
)


def truncated(answer: str) -> bool:
    text = answer.rstrip()
    fences = len(re.findall(r"(?m)^\s*(?:```|~~~)", text))
    if fences % 2:
        return True
    last = text.split("\n")[-1].strip()
    if text.endswith(("```", "~~~")) and fences:
        return False
    if m := _ITEM.match(last):
        return _open_item(last[m.end() :], text)
    if not re.search(r"\s", text):
        return text[-1] in "([{,"  # a word, number or path
    if _DONE.search(text):
        return False
    if _REFERENCE.fullmatch(last):
        return False
    if last[-1] in "([{,;:-–—/\\`\"'“«&+=<":
        return not (last[-1] in "`\"'" and last.count(last[-1]) % 2 == 0) if last[-1] in "`\"'" else True
    if len(text.split()) <= 3 and last.split()[-1].lower() not in _OPEN_WORDS:
        return False  # a short answer without a full stop
    if last.startswith(("|", "#")):
        return False
    return True


def _open_item(item: str, text: str) -> bool:
    """Whether the last entry of a list breaks off: an open word or delimiter at its end, or much shorter than all before it."""
    words = item.split()
    if not words:
        return True
    if _DONE.search(item):
        return False
    if words[-1].lower() in _OPEN_WORDS or item[-1] in "([{,;:":
        return True
    if any(item.count(o) > item.count(c) for o, c in ("()", "[]", "{}")) or item.count("`") % 2:
        return True
    others = [len(_ITEM.sub("", x, count=1).split()) for x in text.split("\n")[:-1] if _ITEM.match(x)]
    return bool(others) and len(words) < min(others) and min(others) >= 3


# --- Spark --------------------------------------------------------------------------------------------------------------------------


def defect_of(question: str | None, answer: str | None) -> str | None:
    if empty(answer):
        return "empty"
    if question and copied(question, answer):
        return "copy"
    if refused(answer):
        return "refusal"
    if question and wrong_language(question, answer):
        return "language"
    return "truncated" if truncated(answer) else None


def defective_pairs(df: DataFrame, id_col: str = "request_id", question_col: str = "question", answer_col: str = "answer", time_col: str | None = "logged_at") -> DataFrame:
    """id and defect of each defective pair."""
    q, a = F.col(question_col).alias("q"), F.col(answer_col).alias("a")
    kind = df.schema[id_col].dataType.simpleString()
    keyed = df.where(F.col(id_col).isNotNull())
    # Rows logged again are mostly equal; only ids and a hash meet in the shuffle, and the latest defect of an id wins.
    at = F.col(time_col).cast("string") if time_col else F.lit("")

    def make() -> Callable:
        def row(key, at, question, answer) -> Iterable[tuple]:
            return [(key, at or "", defect_of(question, answer))]

        return row

    judged = flat_map(keyed, [F.col(id_col).alias("id"), at.alias("at"), q, a], make, f"id {kind}, at string, defect string")
    latest = judged.groupBy("id").agg(F.max_by("defect", F.struct("at", F.coalesce("defect", F.lit("")))).alias("defect"))
    return latest.where("defect is not null").select(F.col("id").alias(id_col), "defect")
