"""Problem 3: broken prompt and response pairs."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, spread
from palimpsest.llm.fold import loose_words, plain_form

#: Share of an answer's words that tiles of the question or prompt must cover, and of the question's that they use.
COPIED, COPIED_FROM = 0.85, 0.8
#: Words of the shortest tile.
TILE = 3
#: Function words that an answer's language needs, and by how many they must exceed those of the question's language.
WORDS_OF_LANGUAGE, AHEAD = 2, 2
#: Words of an answer from which on an end without a mark is looked at, and letters of a broken word.
LEAST_WORDS, LEAST_LETTERS = 4, 1
#: Broken words that all tasks get; more are joined by a shuffle.
FEW_WORDS = 100_000
#: Words of an answer so short that one function word is enough, if none is of the question's language.
SHORT_ANSWER = 6

# What stands for nothing.
STAND_INS = set(
    "na none null nil noanswer noanswergiven noresponse nothing notavailable notapplicable notprovided empty blank leer undefined nan missing tbd tba todo unanswered placeholder "
    "keine keineantwort sinrespuesta aucunereponse pasdereponse nodata noresult answer antwort respuesta reponse response output".split()
)
# Words of each language that seldom occur in the others.
LANGUAGE_WORDS = {
    "en": "the of and was were is are it that which who whose with for from had has have been because this they she he his her their there at by what when where why how did does not into after before about took in no only as to so an then both i you we me my your him them us our am do will would can could should may might must if or but than some any all each other out up down over under again very just through until while during every still also own got get went came made said kept on a met men door",
    "de": "der die das und ist war waren nicht ein eine einen einem einer mit von zu zum zur auf für hat hatte haben weil dass den dem des im wo wer wie warum wann nach bei auch erst noch niemand wollte sehr es sich wurde als aus um kein keine keinen viele tage welche wird sie er ich wir ihr ihre ihren ihrem ihrer mein meine sein seine seinen seinem seiner unser unsere aber oder wenn dann doch nur schon hier dort dieser diese dieses diesen diesem jeder jede alle etwas nichts über unter zwischen durch gegen ohne bis seit während wegen vor hinter neben ob obwohl damit kann können konnte muss musste werden worden wurden sind habe hatten beim vom ins ihn ihm ihnen uns mich dich mehr immer wieder zusammen gegenüber",
    "fr": "à le les des du et est était étaient une dans pour avec qui que qu où quand pourquoi comment au aux sur pas ne ce cette ces il elle ils elles son sa ses leur parce après avant chez été toujours personne combien jours très déjà travaillait vieille la de un en je tu nous vous mes tes nos vos notre votre lui leurs ont avait avaient sont suis être avoir mais donc sous sans entre vers depuis pendant contre cet celui celle ceux puis alors aussi encore tout tous toute toutes même fut furent rien car jamais ensemble",
    "es": "el los las y fue era eran una para con que por qué dónde cuándo cómo del al no su sus lo porque después antes había hasta días cuántos muy nadie nada esta este en la de un dejó compró también yo tú él ella ellos ellas nosotros mi mis tu tus le les se me nos pero sin sobre entre desde hacia durante contra cuando donde como si ya más todo todos toda todas otro otra ese esa eso estos estas han he habían son soy fueron ser estar estaba estaban siempre nunca juntos o",
    "it": "il lo gli che di della del nella nel per con non è era una uno perché dopo prima anche sono stato dove quando come molto più giorni nessuno questo questa io lei lui noi loro mio mia suo sua suoi i le un al alla dal dalla dei delle degli sul sulla tra fra ma se già sempre mai tutto tutti ha hanno aveva avevano erano stata stati fu senza così ed",
    "pt": "o os as que não uma um para com por do da dos das no na em foi era porque depois antes também muito mais dias ninguém onde quando como este esta eu ele ela eles elas nós meu minha seu sua seus suas lhe ao à às pelo pela mas sem sobre entre até desde já sempre nunca tudo todos tem têm tinha foram ser estava estavam são isso isto",
    "nl": "de het een en van is was waren niet met voor op aan dat die deze omdat naar bij ook nog wel geen zijn werd heeft had dagen niemand waar wanneer hoe ik jij hij zij wij ze we mijn haar hun ons onze maar of als dan toen hier daar alle iets niets over onder tussen door tegen zonder tot sinds tijdens kan konden moest worden hebben heb hadden uit om er te altijd nooit weer samen",
    "pl": "to i w na nie jest był była było się że do z po przez bo nikt miał tam stało czyli dla przed jak kiedy gdzie który która bardzo tego jej jego dniach tygodni ja ty on ona oni my wy mój moja swój swoją swoje a ale lub czy gdy tu tutaj ten ta te tych tym nad pod bez od ze we o są byli były być miała mieli ma już tylko zawsze nigdy razem",
    "sv": "och att det som en ett är var inte med för på av till från den har hade efter innan också mycket ingen dagar när där varför hur jag du han hon vi ni de mitt min sin sitt sina hans hennes deras men eller om då här denna detta dessa alla något under över mellan genom mot utan sedan kan kunde måste blev blivit vara varit alltid aldrig igen tillsammans",
    "tr": "bir ve bu için ile değil çok ne neden nasıl nerede sonra önce gün kimse vardı olan daha ben sen o biz siz onlar benim onun onların ama veya eğer şimdi burada orada her hiç şey gibi kadar göre ise idi değildi yok sadece hep asla birlikte",
    "cs": "a je byl byla bylo se že na do z po pro před jak kdy kde který která velmi nikdo protože dnů tam ale já ty on ona oni my vy můj její jeho nebo když tady tento tato nad pod bez od jsou jsem byli být měla měli už jen vždy nikdy spolu",
    "fi": "ja on oli ovat olivat ei ole että se ne hän he minä sinä me te mutta tai kun jos niin kuin myös vain sitten ennen jälkeen kanssa ilman joka mikä mitä missä miksi koska tämä tuo hänen heidän oman koko vielä aina kaikki yksi",
    "hu": "a az és egy nem is hogy volt voltak van vannak ő ők én te mi ti de vagy ha mert már csak még után előtt alatt között nélkül aki ami amely mit hol miért mikor ez ezt azt mindig soha minden lett meg el",
    "da": "og det at som en et er var ikke med for på af til fra den de havde efter inden også meget ingen hvor når hvorfor jeg du han hun vi min sin hans hendes deres men eller hvis da her der denne dette alle noget under over mellem mod uden blev været",
    "no": "og det at som en et er var ikke med for på av til fra den de hadde etter før også mye ingen hvor når hvorfor jeg du han hun vi min sin hans hennes deres men eller hvis da her der denne dette alle noe under over mellom mot uten ble vært",
    "ro": "și în la de pe cu un o nu este era au a fost că care pentru din prin după înainte fără dar sau dacă când unde cum el ea ei ele meu sa său lor acest această mai foarte toate nimic niciodată",
}
_WORDS_OF = {w: [x for x, ws in LANGUAGE_WORDS.items() if w in ws.split()] for ws in LANGUAGE_WORDS.values() for w in ws.split()}
# Words of these lists that stand in names, or in texts of other languages, too.
PARTICLES = set("met war hat die men man door car care come son sin sole dove prima comment pendant ensemble encore min con mis mod mot nu non pan pas pod prin per ser sans sedan sur tai tam tot till van var volt wie worden hen her han hans har hep hon hun fra er era est ed ha dan dar dal dem des ben bis bin bo ale alla ami au cum il im ja jos kan lo lei lui lett lor ma mas mes mi mia mio mit na ne ni nos ob od om op os pe pelo po qu sa sen si su ta te ti til tu um un ve vi wo ya yo ze kun ole oman juntos idi ise ile de del della di da das do dos du des la le les el los las al van von der den ter ten zu y e o a i à en ibn bin st et per via pro no on me so is at to in an am do she he be we us".split())
# Letters that only some of these languages have.
LANGUAGE_LETTERS = {"ß": "de", "ñ": "es", "¿": "es", "¡": "es", "ł": "pl", "ą": "pl", "ę": "pl", "ż": "pl", "ź": "pl", "ś": "pl", "ø": "da", "ã": "pt", "õ": "pt", "ğ": "tr", "ı": "tr", "ř": "cs", "ě": "cs", "ů": "cs"}
# Words that don't end a statement.
OPEN_WORDS = set(
    "the a an and or but nor of to at from with for by into onto upon between among during than as if because although though while since until unless whereas that which who whom whose where when "
    "was were is are be been being am had has have having would could should will shall may might must did does do very my your his their our its this these those every each another such both "
    "der die das den dem des ein eine einen einem einer und oder aber weil dass mit von zu zum zur für im am bei nach aus "
    "le la les un une des du de et ou mais que qui dans pour avec sur chez "
    "el los las del al y o pero con por para en su".split()
)
# Words that join an answer's parts and aren't in any of them.
_JOINTS = {"and", "so", "but", "then"}
# Signs that open and close one another.
BRACKETS = {"(": ")", "[": "]", "{": "}", "“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "（": "）", "［": "］", "【": "】", "〈": "〉", "《": "》"}
VOID_TAGS = {"br", "hr", "img", "input", "meta", "link", "wbr"}
KNOWN_TAGS = set("a b i u p em strong code pre ul ol li div span table tr td th h1 h2 h3 h4 h5 h6 blockquote think answer json xml sub sup s small".split())

_TOKEN = re.compile(r"```|\*\*|__(?=\S)|`|</?(?P<tag>[A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*)?(?P<self>/?)>|[\"“”„«»「」『』()\[\]{}（）［］【】〈〉《》]")
_NEEDS = re.compile(r"[`*_<\"“”„«»「」『』()\[\]{}（）［］【】〈〉《》]")
_QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|„[^“”]*[“”]|«[^»]*»|「[^」]*」|『[^』]*』")
_LABEL = re.compile(r"^\W*(?:(?:the\s+)?(?:final\s+)?(?:answer|response|output|reply|antwort|réponse|respuesta)(?:\s+is)?\s*[:：]\s*)+", re.I)
_FRAME = re.compile(r"^\W*(?:(?:you|i was)\s+asked|(?:the\s+|your\s+|my\s+)?(?:question|query|prompt|instruction|task|frage|pregunta)(?:\s+(?:is|was|reads))?|q)\s*[:：]\s*", re.I)
#: A clause that begins with a conjunction and has no more than what it speaks of.
_HALF_CLAUSE = re.compile(r"\b(?:because|although|though|whereas|unless|whenever|weil|obwohl|dass|parce\s+que|parce\s+qu['’]|porque|aunque)\s*(?:(?:the|a|an|his|her|their|its|my|our|your|der|die|das|ein|eine|seine?|ihre?|le|la|les|un|une|sa|son|ses|el|los|las|una|su|sus)\s+)?[^\W\d_]+$", re.I)
_BARE_ITEM = re.compile(r"(?:^|\n)\s*(?:[-*•]|\d{1,3}[.)])\s*$")
_END = re.compile(r"[.!?。！？…\"'”’»」』）)\]】}*`>]$")
_OPEN_END = re.compile(r"(?:[,;:/&+=(\[{<–—\-、，；：]|\.\.\.|…)$")

# The refusal grammar: openings, then a first person that declines, at the start of the answer.
_OPENING = (
    r"(?:(?:i\s*(?:am|'m)\s+(?:really\s+|very\s+|so\s+|truly\s+)?(?:sorry|afraid)|we\s+are\s+sorry|sorry|my\s+apologies|apologies|i\s+apologi[sz]e|unfortunately|regrettably|thanks?(?:\s+you)?(?:\s+for\s+[^.;,!]{1,40})?|to\s+be\s+honest|honestly|"
    r"as\s+an?\s+(?:ai|artificial|language|large)[^,.;]{0,40}|however|but|hello|hi|well|that\s+said|es\s+tut\s+mir\s+leid|tut\s+mir\s+leid|entschuldigung|leider|je\s+suis\s+désolée?|désolée?|malheureusement|je\s+regrette|lo\s+siento|lamentablemente|disculpa|perdón|mi\s+dispiace|desculpe|к\s+сожалению|извините|przykro\s+mi|niestety|przepraszam)"
    r"[\s,;:.!–—-]*(?:but|that|aber|doch|mais|pero|ma|mas|но|ale)?[\s,;:–—-]*)*"
)
_I = r"(?:i|we)\s*"
_DECLINE = (
    rf"(?:{_I}(?:can(?:\s*not|'t)|could(?:\s+not|n't)|will\s+not|won't|would(?:\s+not|n't)|am\s+(?:not\s+able|unable)|'m\s+(?:not\s+able|unable)|are\s+(?:not\s+able|unable)|am\s+not\s+allowed|'m\s+not\s+allowed|must\s+not|may\s+not)\b"
    rf"(?:\s+(?:to|be|able|possibly|really|currently|simply|in|good|conscience|ever|even)\b)*\s+(?:answer|help|assist|provide|share|comply|discuss|respond|reply|disclose|reveal|say|tell|give|offer|fulfil+|complete|do\s+that|access|recall|remember|support|engage|speculate|comment)"
    rf"|{_I}(?:do\s+not|don't)\s+(?:have|possess|retain|keep)\s+(?:any\s+|the\s+|enough\s+|sufficient\s+)?(?:access|information|knowledge|memory|memories|record|records|data|context|details)"
    rf"|{_I}have\s+no\s+(?:access|information|knowledge|memory|memories|record|records|way|data|recollection)"
    rf"|{_I}(?:must|have\s+to|need\s+to|would\s+have\s+to|respectfully|will\s+have\s+to)?\s*(?:respectfully\s+)?(?:decline|refuse|refrain|pass\s+on\s+(?:this|that))"
    rf"|{_I}(?:would|'d)\s+(?:rather|prefer)\s+not|{_I}prefer\s+not\s+to|{_I}(?:do\s+not|don't)\s+feel\s+comfortable|{_I}(?:am|'m)\s+not\s+comfortable"
    rf"|{_I}(?:do\s+not|don't)\s+know(?:\s+the\s+answer|\s+that|\s+this)?\W*$"
    r"|there\s+is\s+nothing\s+in\s+my\s+(?:memory|records?|data)|it\s+is(?:\s+not|n't)\s+possible\s+for\s+me|it's\s+not\s+possible\s+for\s+me|(?:answering|doing|sharing)\s+(?:this|that|it)\s+would\s+(?:go\s+against|violate)|(?:this|that)\s+(?:request|question)\s+(?:goes\s+against|violates)"
    r"|ich\s+(?:kann|darf|möchte|werde|muss)\b[^.]{0,60}\b(?:nicht|nichts|ablehnen)\b|(?:diese|ihre|die|deine)\s+(?:frage|anfrage|bitte)\s+(?:kann|darf|möchte|werde|muss)\s+ich\b[^.]{0,40}\b(?:nicht|ablehnen)\b|(?:dazu|darauf|darüber|hierzu|das|dabei|damit|hier)\s+(?:kann|darf|möchte|habe|werde)\s+ich\b[^.]{0,40}\b(?:nicht|nichts|keine|keinen)\b|(?:dazu\s+)?(?:habe\s+ich|ich\s+habe)\s+(?:leider\s+)?(?:dazu\s+)?(?:keinen\s+zugriff|keine\s+(?:information|angabe|erinnerung|daten))"
    r"|je\s+ne\s+(?:peux|puis|pourrai)\s+pas|je\s+n'ai\s+pas\s+(?:accès|d'information)|je\s+préfère\s+ne\s+pas|je\s+(?:dois|refuse)\b[^.]{0,30}(?:refuser|décliner|de\s+répondre)|il\s+(?:ne\s+)?m'est\s+(?:pas\s+possible|impossible)|je\s+ne\s+(?:sais|suis)\s+pas\s+(?:en\s+mesure|répondre|autorisée?)|aucune\s+information\b"
    r"|no\s+(?:me\s+)?(?:puedo|es\s+posible|está\s+permitido)\b|no\s+(?:tengo|dispongo)\s+(?:de\s+)?(?:acceso|información|datos)|prefiero\s+no|debo\s+(?:declinar|rechazar)|non\s+posso\s+(?:rispondere|aiutare|condividere)|não\s+posso\s+(?:responder|ajudar|compartilhar)"
    r"|(?:я\s+)?не\s+могу\s+(?:ответить|помочь|поделиться)|у\s+меня\s+нет\s+(?:доступа|информации)|nie\s+mogę\s+(?:odpowiedzieć|pomóc)|nie\s+mam\s+(?:dostępu|informacji))"
)
# How an answer in a script of its own declines.
REFUSALS_ELSEWHERE = ("お答えできません", "答えられません", "回答できません", "无法回答", "不能回答")
# Further sentences that decline, put together from who speaks, what is denied, what is not done and to what.
_NOT = r"(?:not|n't|never|hardly)"
_ACT = r"(?:answer|help|assist|provide|share|comply|discuss|respond|reply|disclose|reveal|comment|speak|talk|address|weigh\s+in|go\s+into|get\s+into|say|tell|give\s+out|look\s+up|retrieve|verify|determine)"
_MATTER = r"(?:(?:this|that|it|such|these|those)(?:\s+(?:question|request|query|matter|topic|subject|information|detail|details|kind\s+of\s+\w+|sort\s+of\s+\w+))?|the\s+(?:question|request|query|answer|information|details?|topic|subject)(?:\s+(?:you|that|requested|asked)[^.]{0,30}?)?)"
_RULES = r"(?:guidelines?|policy|policies|instructions?|programming|rules?|training|principles|settings|design|restrictions)"
_KNOWLEDGE = r"(?:information|knowledge|context|details?|data|facts?|access|means|ability|permission|authority|records?|memory|background|expertise)"
_OTHERWISE = (
    rf"(?:{_MATTER}\s*(?:is|are|was|'s)\s*{_NOT}\s+(?:something|anything|a\s+\w+|one)\s+(?:that\s+)?{_I}(?:can|could|am\s+able\s+to|will|would|may|want\s+to|wish\s+to|feel)\b"
    rf"|{_MATTER}\s*(?:is|are|'s|lies?|falls?)\s*(?:simply\s+|currently\s+|just\s+)?(?:(?:{_NOT}\s+)(?:available|accessible|known|visible|possible)|unavailable|inaccessible|unknown|hidden|off\s+limits)\s+(?:to|for)\s+(?:me|us)\b"
    rf"|{_MATTER}\s*(?:is|are|'s|lies?|falls?|goes)\s+(?:well\s+)?(?:outside|beyond)\s+(?:of\s+)?(?:my|our|what\s+(?:i|we))\b"
    rf"|(?:my|our)\s+{_RULES}\s+(?:(?:do|does|will|would|can)\s*{_NOT}\s+(?:allow|let|permit)|(?:can)?not\s+(?:allow|let|permit)|prevents?|forbids?|prohibits?|bars?|keeps?|stops?|restricts?|disallows?|rules?\s+(?:this|that|it)\s+out)\b"
    rf"|{_I}(?:simply\s+|currently\s+|just\s+)?(?:lack|am\s+(?:lacking|missing|without)|'m\s+(?:lacking|missing|without))\s+(?:the\s+|any\s+|enough\s+|sufficient\s+|that\s+|this\s+)?(?:\w+\s+)?{_KNOWLEDGE}\b"
    rf"|{_I}(?:must|should|will|'ll|'d|would|have\s+to|need\s+to|am\s+going\s+to|'m\s+going\s+to|'m|am)?\s*(?:have\s+to\s+|need\s+to\s+|respectfully\s+|better\s+)?(?:pass|passing|skip|abstain|abstaining|sit)\s+(?:on\s+|from\s+)?(?:here|this|that|it|answering|this\s+one|out)\b"
    rf"|{_I}(?:do\s+not|don't|will\s+not|won't|would\s+not|wouldn't)\s+(?:\w+\s+)?(?:wish|want|intend|plan|care)\s+to\s+{_ACT}\b"
    rf"|{_I}(?:am|'m|have\s+been|was)\s+(?:{_NOT}\s+)?(?:forbidden|prohibited|barred|restricted|instructed\s+{_NOT}|told\s+{_NOT}|permitted|authori[sz]ed|in\s+a\s+position|equipped|designed|programmed)\s+(?:to\s+|from\s+)?{_ACT}"
    r"|no\s+comment\W*$|no\s+can\s+do\b|(?:you(?:'ll|\s+will)\s+(?:have|need)\s+to|please)\s+(?:ask|consult)\s+(?:someone|somebody|another|anyone)\s+else\b)"
)
_REFUSAL = re.compile(rf"^\W*{_OPENING}(?:{_DECLINE}|{_OTHERWISE})", re.I)
_MAY_REFUSE = re.compile(r"\b(?:i|we|my|me|us|our|no\s+comment|no\s+can|someone|somebody|ich|je|j|il|no|non|não|не|меня|nie|aucune|prefiero|debo)\b", re.I)


def unfinished(text: str) -> bool:
    """Whether a pushdown parser is left with something open at the end of the text.

    It follows fences, code spans, bold marks, quotations, brackets of all kinds
    and tags; closers without an opener are passed over, and so are openers that
    a closer further out shows to be no openers. A list that ends with a bare
    item mark is unfinished too.
    """
    if _BARE_ITEM.search(text) and "\n" in text.strip():
        return True
    if not _NEEDS.search(text):
        return False
    stack: list[str] = []
    fence = False
    for m in _TOKEN.finditer(text):
        t = m.group()
        if t == "```":
            fence = not fence
            if fence:
                stack.append(t)
            else:
                while stack and stack.pop() != t:
                    pass
            continue
        if fence:
            continue
        if m.group("tag"):
            name = m.group("tag").lower()
            if m.group("self") or name in VOID_TAGS or name not in KNOWN_TAGS:
                continue
            if t.startswith("</"):
                if f"<{name}>" in stack:
                    while stack.pop() != f"<{name}>":
                        pass
            else:
                stack.append(f"<{name}>")
        elif t in '"`**__':
            if t == '"' and m.start() and text[m.start() - 1] == "\\":
                continue
            if t == '"' and t not in stack and m.start() and text[m.start() - 1].isdigit() and (m.end() == len(text) or not text[m.end()].isalnum()):
                continue  # inches
            if t in stack:
                while stack.pop() != t:
                    pass
            elif t not in ("**", "__") or (m.end() < len(text) and not text[m.end()].isspace()):
                stack.append(t)
        elif t in BRACKETS and not (t == "“" and "„" in stack):
            stack.append(t)
        else:
            opener = next((o for o in reversed(stack) if t in BRACKETS.get(o, "")), None)
            if opener:
                while stack.pop() != opener:
                    pass
    return bool([s for s in stack if s not in ("__",)])


def tiles(a: Sequence[str], b: Sequence[str], least: int = TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in a, start in b, length), the longest first, no word used twice.

    Matches are looked for from runs of ``least`` words that both have, and
    only from where they begin.
    """
    free_a, free_b = [True] * len(a), [True] * len(b)
    result = []
    while True:
        where: dict[tuple[str, ...], list[int]] = {}
        for j in range(len(b) - least + 1):
            if all(free_b[j : j + least]):
                where.setdefault(tuple(b[j : j + least]), []).append(j)
        longest, found = least, []
        for i in range(len(a) - least + 1):
            if not all(free_a[i : i + least]):
                continue
            for j in where.get(tuple(a[i : i + least]), ()):
                if i and j and free_a[i - 1] and free_b[j - 1] and a[i - 1] == b[j - 1]:
                    continue  # part of a match that began before
                n = least
                while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                    n += 1
                if n > longest:
                    longest, found = n, []
                if n == longest:
                    found.append((i, j))
        marked = False
        for i, j in found:
            if all(free_a[i : i + longest]) and all(free_b[j : j + longest]):
                free_a[i : i + longest] = free_b[j : j + longest] = [False] * longest
                result.append((i, j, longest))
                marked = True
        if not marked:
            return result


def is_copy(answer: Sequence[str], source: Sequence[str], question: Sequence[str]) -> bool:
    """Whether the answer's words are the source's and give back the question."""
    if len(answer) < 4 or not source:
        return False
    known = set(source)
    if sum(w in known for w in answer) < COPIED * len(answer):
        return False
    # Whole copies of the source or the question in a row are taken off at once.
    start, used = 0, 0
    for whole in (list(source), list(question)):
        while whole and list(answer[start : start + len(whole)]) == whole:
            start += len(whole)
            used = max(used, len(whole))
    rest, covered = list(answer[start:]), start
    while len(rest) >= TILE:
        parts = tiles(rest, source)
        got = sum(n for *_, n in parts)
        if not got or (used and got < COPIED_FROM * min(len(question) or len(source), len(source))):
            break
        used = max(used, got)
        covered += got
        gone = {i for s, _, n in parts for i in range(s, s + n)}
        rest = [w for i, w in enumerate(rest) if i not in gone]
    if covered < COPIED * len(answer):
        return False
    head = min(len(answer), len(question))
    begins = head >= 4 and list(answer[:head]) == list(question[:head]) and head >= 0.4 * len(question)
    return used >= COPIED_FROM * len(question) or begins or covered >= max(8, 0.5 * len(source))


def language(text: str) -> tuple[str, dict[str, int]]:
    """(script or language, function words by language) of a text; "" where nothing tells."""
    counts: dict[str, int] = {}
    scripts: dict[str, int] = {}
    letters = 0
    if not text.isascii():
        for c in text:
            o = ord(c)
            if o < 0x80:
                letters += c.isalpha()
                continue
            if not c.isalpha():
                continue
            letters += 1
            kind = "cyrillic" if 0x400 <= o < 0x530 else "greek" if 0x370 <= o < 0x400 else "kana" if 0x3040 <= o < 0x3100 else "han" if 0x4E00 <= o < 0xA000 else "hangul" if 0xAC00 <= o < 0xD7B0 else "arabic" if 0x600 <= o < 0x700 else "hebrew" if 0x590 <= o < 0x600 else "devanagari" if 0x900 <= o < 0x980 else "thai" if 0xE00 <= o < 0xE80 else ""
            if kind:
                scripts[kind] = scripts.get(kind, 0) + 1
            elif c.lower() in LANGUAGE_LETTERS:
                x = LANGUAGE_LETTERS[c.lower()]
                counts[x] = counts.get(x, 0) + 1
        if "¿" in text or "¡" in text:
            counts["es"] = counts.get("es", 0) + 2
    if scripts and 2 * sum(scripts.values()) > letters:
        kind = max(scripts, key=scripts.get)
        return ("ja" if "kana" in scripts else kind), {}
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        if w.endswith("ó") and len(w) > 3:  # a past tense
            counts["es"] = counts.get("es", 0) + WORDS_OF_LANGUAGE + 1
        for x in _WORDS_OF.get(w, ()):
            counts[x] = counts.get(x, 0) + 1
    best = max(counts, key=lambda x: (counts[x], x == "en"), default="")
    return best, counts


def other_language(question: str, answer: str) -> bool:
    """Whether an answer is in another language than its question; quotations don't count."""
    bare = _QUOTED.sub(" ", answer)
    if len(bare.split()) >= 3 or not _QUOTED.search(answer):
        answer = bare
    a, in_a = language(answer)
    if not a:
        return False
    q, in_q = language(question)
    if not q:
        return False
    if not in_a or not in_q:  # one of them has a script of its own
        return a != q
    words = re.findall(r"[^\W\d_]+", answer)
    if a != q and len(words) <= SHORT_ANSWER and not in_a.get(q) and in_q[q] >= WORDS_OF_LANGUAGE:
        # Capitalized words may be names.
        return in_a[a] >= WORDS_OF_LANGUAGE or any(w.islower() and w not in PARTICLES and a in _WORDS_OF.get(w, ()) for w in words)
    return a != q and in_a[a] >= WORDS_OF_LANGUAGE and in_a[a] - in_a.get(q, 0) >= AHEAD and in_q[q] >= WORDS_OF_LANGUAGE


def breaks_off(text: str, words: Sequence[str], components: Sequence[str], broken_word: bool = False) -> bool:
    """Whether an answer breaks off before its end; ``broken_word`` says that its last word is a part of one."""
    bare = text.rstrip()
    if unfinished(bare):
        return True
    if _OPEN_END.search(bare):
        return True
    if _END.search(bare) or len(words) < 2:
        return False
    last = bare.split()[-1].lower().strip("'’")
    if last in OPEN_WORDS or (broken_word and len(words) >= LEAST_WORDS):
        return True
    if len(words) >= LEAST_WORDS and _HALF_CLAUSE.search(bare):
        return True
    # The parts that the answer should have: do they, one by one or in a row, go on behind the answer's last words?
    if len(words) < 4:
        return False
    parts = [[w for w in loose_words(p or "") if w not in _JOINTS] for p in components]
    tail = [w for w in words[-6:] if w not in _JOINTS][-3:]
    if len(tail) < 2 or any(c[-len(tail) :] == tail for c in parts):
        return False
    goes_on = False
    for c in [*parts, [w for p in parts for w in p]]:
        for i in range(len(tail) - 1, len(c)):
            if c[i - len(tail) + 1 : i] == tail[:-1] and c[i].startswith(tail[-1]) and (i + 1 < len(c) or c[i] != tail[-1]):
                goes_on = True
    return goes_on


def unwrap(text: str) -> tuple[str, bool]:
    """(the answer inside a JSON object, array, string or label; whether the JSON is broken)."""
    s = text.strip()
    broken = False
    if s[:1] in '{["' and len(s) > 1:
        try:
            value = json.loads(s)
            parts: list[str] = []
            todo = [value]
            while todo:
                v = todo.pop()
                if isinstance(v, dict):
                    todo += reversed(v.values())
                elif isinstance(v, list):
                    todo += reversed(v)
                elif v is not None:
                    parts.append(str(v))
            s = " ".join(parts)
        except (ValueError, RecursionError):
            m = re.match(r'^\{\s*"[\w ]+"\s*:\s*"?', s)
            if m:
                s, broken = s[m.end() :], True
    return _LABEL.sub("", s), broken


def defect(question: str | None, prompt: str | None, answer: str | None, components: Sequence[str] | None = None, broken_word: bool = False) -> str | None:
    """The defect of an answer to its question (or prompt), or null.

    empty: null, without a letter or digit, or only a stand-in for nothing;
    copied: gives back the question or prompt and nothing else; refusal: the
    answer itself declines, told refusals and quoted ones don't count;
    other_language: another language or script than the question's; truncated:
    something is left open, or the last word can't be the last, being open, the
    mere subject of a clause, or a part of a word (``broken_word``). The first that
    holds, in this order. A null question only rules out copied and
    other_language.
    """
    if answer is None:
        return "empty"
    text, broken = unwrap(plain_form(answer))
    words = loose_words(text)
    inner = text.strip().strip("<>()[]{}\"'.-–—*_ ")
    if not words or "".join(words) in STAND_INS or ("".join(loose_words(inner)) in STAND_INS and len(words) <= 3):
        return "empty"
    asked = loose_words(question) if question else []
    framed = loose_words(_FRAME.sub("", text))
    if asked and (is_copy(framed, asked, asked) or framed == asked):
        return "copied"
    if prompt and len(words) >= 8 and is_copy(words, loose_words(prompt), asked):
        return "copied"
    if _MAY_REFUSE.search(text) or any(m in text for m in REFUSALS_ELSEWHERE):
        told = _QUOTED.sub(" ", text)
        plain = (told if len(told.split()) >= 3 else text).replace("’", "'")
        if _REFUSAL.search(plain) or any(m in plain for m in REFUSALS_ELSEWHERE):
            return "refusal"
    if question and other_language(question, text):
        return "other_language"
    if broken or breaks_off(text, words, components or (), broken_word):
        return "truncated"
    return None


def task_pairs(dialogues: DataFrame) -> DataFrame:
    """The pairs of the tasks: (tab, row_id, task_idx, question, prompt, answer, components)."""
    tasks = dialogues.select("row_id", F.posexplode("tasks_covered").alias("task_idx", "t"))
    return tasks.where("t IS NOT NULL").select(F.lit("dialogue_records").alias("tab"), "row_id", "task_idx", F.col("t.query").alias("question"), F.lit(None).cast("string").alias("prompt"), F.col("t.gold_answer").alias("answer"), F.col("t.answer_components").alias("components"))


def asked_in(prompt: F.Column) -> F.Column:
    """The question of a prompt: what stands behind its last line "### Question", up to the next heading."""
    return F.nullif(F.trim(F.regexp_extract(prompt, r"(?s).*### Question[^\n]*\n(.*?)(?:\n### .*)?$", 1)), F.lit(""))


def record_pairs(records: DataFrame) -> DataFrame:
    """The pairs of the evaluation records, with the prompt's question where the query is null or blank."""
    query = F.col("record.metadata.query")
    question = F.when(F.length(F.trim(query)) > 0, query).otherwise(asked_in(F.col("record.prompt")))
    return records.select(F.lit("parametric_eval_records").alias("tab"), "row_id", F.lit(-1).alias("task_idx"), question.alias("question"), F.col("record.prompt").alias("prompt"), F.col("record.reference").alias("answer"), F.col("record.metadata.answer_components").alias("components"))


def _words_of(text: F.Column) -> F.Column:
    return F.split(F.lower(text), r"[^\p{L}\p{M}\p{Nd}'’]+")


def broken_words(pairs: DataFrame) -> DataFrame:
    """(last): what stands at the unmarked end of answers and is no word of any question or answer but begins one.

    The words known are those of all questions and answers, of an answer without
    an end mark but its last; a word begins another one that occurs at least
    twice. Nothing is collected: words and their beginnings are joined.
    """
    open_ = last_word(F.col("answer"))
    words = _words_of(F.col("answer"))
    own = F.when(open_ == "", words).otherwise(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))))
    used = pairs.select(F.explode(own).alias("w")).unionByName(pairs.select(F.explode(_words_of(F.col("question"))).alias("w")))
    known = cut(used.where("w <> ''").groupBy("w").agg(F.count("*").alias("n")))
    ends = pairs.select(open_.alias("last")).where(F.length("last") >= LEAST_LETTERS).distinct()
    unknown = cut(ends.join(known.withColumnRenamed("w", "last"), "last", "left_anti"))
    longest = unknown.agg(F.coalesce(F.max(F.length("last")), F.lit(0)).alias("most"))  # one row
    begun = known.where("n > 1").crossJoin(F.broadcast(longest)).where("most > 0 AND length(w) > 1").select(F.explode(F.expr("transform(sequence(1, greatest(1, least(length(w) - 1, most))), i -> left(w, i))")).alias("last"))
    return unknown.join(begun, "last", "left_semi")


def last_word(answer: F.Column) -> F.Column:
    """The last word of an answer of LEAST_WORDS words or more that ends without a mark, else empty."""
    flat = F.rtrim(F.translate(answer, "\n\t\r", "   "))
    word = F.substring_index(flat, " ", -1)
    blanks = F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit("")))
    return F.when((blanks >= LEAST_WORDS - 1) & word.rlike(r"^[\p{L}\p{M}'’]*\p{L}$"), F.lower(word)).otherwise("")


def find_defects(pairs: DataFrame) -> DataFrame:
    """(tab, row_id, task_idx, defect) of the pairs whose answer is defective.

    pairs as :func:`task_pairs` gives them; each row is judged by itself, but
    for the words known from all pairs (:func:`broken_words`), so repeated rows
    each count. Texts are read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tab, row, idx, question, prompt, answer, components, broken = (b.column(i).to_pylist() for i in range(8))
            kinds = [defect(*x) for x in zip(question, prompt, answer, components, broken, strict=True)]
            keep = [i for i, k in enumerate(kinds) if k]
            columns = [[x[i] for i in keep] for x in (tab, row, idx, kinds)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.string()), strict=True)], names=["tab", "row_id", "task_idx", "defect"])

    broken = cut(broken_words(pairs).withColumn("broken", F.lit(True)))
    if broken.count() <= FEW_WORDS:
        broken = F.broadcast(broken)
    marked = pairs.withColumn("last", F.coalesce(last_word(F.col("answer")), F.lit(""))).join(broken, "last", "left")
    ordered = marked.select("tab", "row_id", "task_idx", "question", "prompt", "answer", "components", F.coalesce("broken", F.lit(False)).alias("broken"))
    return spread(ordered).mapInArrow(run, "tab string, row_id long, task_idx int, defect string")
