"""Refusals by grammar: who declines (negated ability, permission or will; a verb of refusing), what (a verb of answering) and of what (its object).

An automaton of cues finds the sentences worth a look.  A sentence refuses when its
parts fit together in one clause, in any of the languages below.  A refusal is
withdrawn when a value is stated after it, and a sentence that only limits a method
("not directly", "without a table") is none while the text goes on.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

import ahocorasick


class Grammar(NamedTuple):
    """Patterns of one language; each is searched in a clause in lower case."""

    cues: str  # parts of words, separated by ``|``, one of which every refusal has
    neg: str  # first person and negated ability, permission or will
    helps: str  # verbs that need no object
    verb: str  # verbs of answering
    obj: str  # what is declined
    refuse: str  # verbs of refusing
    nothing: str  # "no answer"
    give: str  # what isn't done with it
    policy: str  # rules that forbid
    sorry: str
    limit: str  # only a way of doing it is excluded


# Function words, modal verbs and nouns of each language.
GRAMMARS = {
    "en": Grammar(
        "can't|cannot|can not|won't|will not|unable|not able|not allowed|not permitted|not authori|not willing|rather not|prefer not|refus|declin|not something|not going to|not in a position|i do not|i don't|we do not|we don't"
        "|guidelines|policy|policies|outside my|outside what|outside our|beyond my|beyond what|beyond our|not possible for|impossible for|no answer|no result|no solution|no response|comfortable|abstain|couldn't|could not|i may not|we may not|i must not|isn't something|incapable|nothing will|nothing can",
        r"\b(?:i|we)(?:'m|'re|'d|'ll)?(?: \w+){0,3}? ?(?:can't|cannot|can not|couldn't|could not|won't|will not|may not|must not|mustn't|shouldn't|should not|(?:do not|don't)(?= (?:\w+ )?(?:answer|solve|respond|reply|handle|provide|give|offer|help|assist|do|deal|discuss|take))"
        r"|unable to|incapable of|not able to|not allowed to|not permitted to|not authori[sz]ed to|not willing to|not going to|not in a position to|rather not|prefer not|not comfortable|uncomfortable|not supposed to)"
        r"|\bnot something (?:that )?(?:i|we) (?:can|may|could|am|will)|\b(?:outside|beyond) (?:of )?(?:what (?:i|we)|my\b|our\b)|(?:impossible|not possible) for (?:me|us)|^(?:\W|but|and|so|sorry)*(?:can't|cannot|unable to|not able to|won't)\b|\bby me\b.*\bcannot\b|\b(?:cannot|can't|will not|won't|not) be \w+ed by (?:me|us)\b",
        r"\b(?:help|assist)\b",
        r"\b(?:answer(?:ing)?|solv(?:e|ing)|respond(?:ing)?|reply(?:ing)?|provid(?:e|ing)|giv(?:e|ing)|offer(?:ing)?|shar(?:e|ing)|supply|tell(?:ing)?|say|work(?:ing)? (?:this|that|it|on|out)|complet(?:e|ing)|comply(?:ing)?|fulfil\w*|engag(?:e|ing)|tak(?:e|ing) part|participat(?:e|ing)"
        r"|continu(?:e|ing)|proceed|discuss|process|handl(?:e|ing)|do|attempt|tackl(?:e|ing)|produc(?:e|ing)|generat(?:e|ing)|comment|deal(?:ing)?|address|reveal|comput(?:e|ing)|determin(?:e|ed)|figure|resolv(?:e|ing)|box)\b",
        r"\b(?:this|that|these|those|such|your|it|here)\b(?! (?:rule|row|example|method|step|way|value|line|pattern|pair|table|operation|letter|column))|\b(?:question|puzzle|task|request|riddle|exercise|prompt|query)s?\b|\b(?:an?|the|any|final|correct) (?:\w+ ){0,2}(?:answer|solution|result|response|reply|output)\b|\byou\b",
        r"\b(?:refuse|refusing|decline|declining|abstain(?:ing)?)\b|\b(?:request|task|question|puzzle) (?:is|was|has been) (?:refused|declined)\b",
        r"\b(?:no|not any|nothing)\b(?: \w+){0,2}? ?(?:answer|result|solution|response|reply|output|value|box\w*)|\bnothing (?:will|can|shall|is going to)",
        r"\b(?:given|provided|offered|supplied|stated|shared|boxed|produced|available|forthcoming|possible|from me|by me|from us|for you|i (?:can|will|may) (?:give|offer|provide))\b",
        r"\b(?:my|our|the|company|usage|safety|content) (?:\w+ )?(?:guidelines|policy|policies|rules|instructions|principles|terms)\b.*(?:(?:\bnot|n't|\bnever) (?:\w+ )?(?:allow|let|permit|enable)|forbid|prevent|prohibit|keep me from|stop me from)|\bagainst (?:my|our) (?:guidelines|policy|policies|rules|instructions|principles|programming)",
        r"\b(?:sorry|apologi\w+|regret\w*|unfortunately|afraid|forgive)\b",
        r"\b(?:directly|immediately|at once|at first|yet|by hand|by inspection|alone|without|until|unless|before|from|using|in one (?:step|go)|in my head|so (?:i|we|let)|therefore|instead|but (?:i|we) can\b(?!')|with (?:only|just))\b",
    ),
    "de": Grammar(
        "nicht|kein|unmöglich|außerstande|ausserstande|ablehn|abzulehnen|weiger|verzicht|lehne|richtlinie|vorgaben",
        r"(?=.*\b(?:ich|mir|wir|uns)\b)(?=.*(?:\b(?:kann|könn\w+|darf|dürf\w+|werde|will|möchte|mag|bin|sind|ist|wäre|sehe|beantworte|löse|bearbeite|behandle|gebe|liefere|helfe|erteile)\b))(?=.*(?:\b(?:nicht|kein\w*|niemals|nie|unmöglich)\b|außerstande|ausserstande))",
        r"helfen|helfe\b|behilflich|unterstütz|weiterhelf|beistehen",
        r"beantwort|antworten\b|\blösen\b|\blöse\b|auflös|bearbeit|\bgeben\b|\bgebe\b|\bnennen\b|\bliefer|anbieten|mitteil|verraten|erteil|ausführ|fortfahr|fortsetz|eingehen|nachkomm|erfüll|\bsagen\b|behandel|behandl|angeben|bereitstell|rechnen|weitermach",
        r"\bfragen?\b|aufgabe|rätsel|anfrage|\bbitte\b|problem|antwort|lösung|ergebnis|auskunft|übung|\bdas\b|\bdies\w*|\bdazu\b|\bdabei\b|\bdamit\b|\bihnen\b|\bdir\b|anliegen|wunsch|\bhier(?:bei|auf|zu)\b|\bdarauf\b|\bso etwas\b|\bsolche\w*",
        r"\bablehnen\b|abzulehnen|\blehnen?\b.*\bab\b|\bweigern?\b|\bweigere\b|\bverweigere?\b|\bverweigern\b|verzicht(?:e|en)\b|\babsehen\b|\babstand\b",
        r"\bkeine?n? (?:\w+ )?(?:antwort|lösung|ergebnis|auskunft|resultat|wert)",
        r"\bgeb|gibt|gegeben|verfügung|verfügbar|angeboten|anbieten|möglich|liefer|mitgeteilt|genannt|nennen|erfolg|erhalt|von mir|bekomm|erteil",
        r"\b(?:meine|unsere|geltenden) (?:\w+ )?(?:richtlinien|vorgaben|regeln|bestimmungen|anweisungen)\b.*(?:nicht|kein|untersag|verbiet|verwehr)",
        r"tut mir|\bleider\b|entschuldig|bedau|verzeih|sorry",
        r"\bdirekt\b|\bsofort\b|\bnoch nicht\b|\bohne\b|\bbevor\b|\bsolange\b|\ballein\b|\baus dem\b|\bim kopf\b|\balso\b|\bdaher\b|\bdeshalb\b|\bauf anhieb\b|\bnur mit\b",
    ),
    "fr": Grammar(
        "je ne |je n'|nous ne |nous n'|on ne |ne m'|ne me |préfère ne|préférerais ne|aucune |pas de |nulle |impossible|incapable|incapacité|pas en mesure|refus|déclin|decline|abst|directives|consignes",
        r"\b(?:je|nous|j'|m'|me|on)\b.*\b(?:ne|n')\s?(?:\w+ |\w+')?(?:peux|puis|pouvons|pourrai\w*|saurai\w*|suis|sommes|dois|vais|veux|souhaite|traite|réponds?|résous|donne|fournis|aide)|\bpréf(?:è|é)r\w+ (?:ne |m'abst)|\bimpossible (?:de|d'|pour moi)|\bm'est (?:\w+ )?(?:impossible|interdit)|\bincapable de|incapacité (?:de|d')|\bpas en mesure",
        r"\baider?\b|\bassister\b|venir en aide|être utile",
        r"répond|résou|\bdonne|fourni|propos|indiqu|trait|continu|poursuiv|satisf|accéder|\bdire\b|livrer|communiqu|\boffrir|apport|accompli|exécut|partag|\bfaire\b|\baborder|donner suite",
        r"question|énigme|demande|problème|tâche|exercice|requête|réponse|solution|résultat|\bcela\b|\bça\b|\bceci\b|sujet|devinette|\bgenre\b|casse-tête|\bvous\b|\bte\b|\by\b",
        r"\brefuse\b|\brefuser\b|\brefusons\b|\bdécline\b|\bdécliner\b|m'abst|abstenir",
        r"\b(?:aucune?|pas de|nulle) (?:\w+ )?(?:réponse|solution|résultat|aide|valeur)",
        r"donn|fourni|propos|communiqu|possible|apport|livr|offert|disponible|de ma part|par moi|indiqu",
        r"\b(?:mes|nos|les) (?:\w+ )?(?:directives|règles|consignes|instructions|principes)\b.*(?:\bne\b|\bn'|interdi|empêch)",
        r"désolé|regrett|malheureusement|pardon|excus|navré",
        r"directement|\btout de suite|\bencore\b|\bsans\b|\bavant\b|\bseule?(?:ment)?\b|\bà partir\b|\bdonc je\b|\balors je\b|\bde tête\b|\bd'emblée\b",
    ),
    "es": Grammar(
        "no puedo|no pod|no debo|no voy|no quiero|no deseo|no estoy|no es posible|no está|no soy|no resuelvo|no respondo|no contesto|no trato|no atiendo|no doy|no dar|no ofrezco|no proporc|no corresp|no permit|no sabr|no me |no le |no te |no se |no hay|no habr|no existe|iero no|iría no|ningun|imposible|incapaz|rechaz|niego|negarme|rehús|rehus|declin|absten|normas|directrices",
        r"\bno (?:\w+ )?(?:puedo|podemos|podré|podría|debo|voy a|quiero|deseo|estoy (?:en condiciones|autorizad|capacitad|dispuest)|es posible|está permitid|soy capaz|resuelvo|respondo|contesto|trato|atiendo|doy|daré|ofrezco|proporciono|corresponde|permiten|sabría)|\bprefiero no\b|\bpreferiría no\b|\bimposible (?:para mí|responder|resolver|ayudar|dar)|\bme (?:\w+ )?imposible|\bincapaz de",
        r"\bayud|\basist|\bcolabor",
        r"respond|contest|resolv|resuelv|\bdar(?:te|le|les|os)?\b|\bdoy\b|\bdaré\b|ofrec|ofrezc|proporcion|facilit|entreg|continu|\bseguir\b|atend|atiend|\btrat|complet|cumplir|\bdecir|indicar|brind|realizar|revel|compart|\bhacer",
        r"pregunta|acertijo|problema|tarea|solicitud|petición|ejercicio|enigma|respuesta|solución|resultado|\beso\b|\besto\b|\bello\b|\btema\b|\btipo\b|\bclase\b|rompecabezas|consulta|adivinanza|\bte\b|\ble\b|\best[aeo]s?\b",
        r"\brechazo\b|\brechazar|rechazamos|me niego|negarme|rehúso|rehuso|\brehusar|\bdeclino\b|\bdeclinar|me abstengo|abstenerme",
        r"\bningun[ao]? (?:\w+ )?(?:respuesta|solución|resultado|ayuda|valor)|\bno (?:hay|habrá|existe|se (?:dará|ofrec\w+|puede)) (?:\w+ )?(?:respuesta|solución|resultado)",
        r"\bdar|\bdoy|dado|ofrec|proporcion|posible|disponible|entreg|de mi parte|por mí|habrá|facilit",
        r"\b(?:mis|nuestras|las) (?:\w+ )?(?:normas|directrices|reglas|instrucciones|políticas|pautas)\b.*(?:\bno\b|prohíb|impid)",
        r"lo siento|lament|disculp|perdón|perdon|desafortunad|desgraciad|desgracia",
        r"directamente|\bde inmediato|\btodavía\b|\baún\b|\bsin\b|\bantes\b|\bsolo con\b|\bsólo con\b|\ba partir\b|\basí que\b|\bpor eso\b|\bde memoria\b|\ba simple vista\b",
    ),
    "pt": Grammar(
        "não posso|não pod|não devo|não vou|não irei|não quero|não desejo|não consigo|não estou|não é |não sou|não resolvo|não respondo|não trato|não atendo|não dou|não darei|não forneço|não ofereço|não cabe|não sab|não me |não lhe |não te |não há|não haver|não existe|não será|nao posso|nao |iro não|eria não|nenhuma|impossível|incapaz|recus|nego|negar-me|declin|abst|rejeit|diretrizes|normas",
        r"\bn[ãa]o (?:\w+ )?(?:posso|podemos|poderei|poderia|devo|vou|irei|quero|desejo|consigo|estou (?:em condições|autorizad|apt|dispost|habilitad)|é (?:possível|permitid)|sou capaz|resolvo|respondo|trato|atendo|dou|darei|forneço|ofereço|cabe|saberia)|\bprefiro n[ãa]o\b|\bpreferia n[ãa]o\b|\bimpossível (?:para mim|responder|resolver|ajudar|dar)|\bincapaz de",
        r"\bajud|\bauxili|\bassist|\bcolabor",
        r"respond|resolv|\bdar(?:-lhe|-te)?\b|\bdou\b|\bdarei\b|oferec|fornec|forneç|continu|prossegu|atend|\btrat|complet|cumpr|\bdizer|indicar|apresent|realiz|revel|partilh|compartilh|conclu|\bfazer",
        r"pergunta|enigma|charada|problema|tarefa|pedido|solicitação|exercício|resposta|solução|resultado|\bisso\b|\bisto\b|\btema\b|\btipo\b|questão|\blhe\b|\bte\b|quebra-cabeça|adivinha|\bdisso\b|\bnisso\b|\best[ae]s?\b|\bess[ae]s?\b",
        r"\brecuso|\brecusar|recusamos|me nego|nego-me|negar-me|\bdeclino\b|\bdeclinar|abstenho|abster|\brejeito\b|\brejeitar",
        r"\bnenhum[a]? (?:\w+ )?(?:resposta|solução|resultado|ajuda|valor)|\bn[ãa]o (?:há|haverá|existe|será dada) (?:\w+ )?(?:resposta|solução|resultado)?",
        r"\bdar|\bdou|dada|oferec|fornec|possível|disponível|entreg|da minha parte|por mim|haverá|resposta",
        r"\b(?:minhas|nossas|as) (?:\w+ )?(?:diretrizes|normas|regras|instruções|políticas)\b.*(?:\bn[ãa]o\b|proíb|imped)",
        r"sinto muito|lament|desculp|infelizmente|perdão|perdoe",
        r"diretamente|\bde imediato|\bainda\b|\bsem\b|\bantes\b|\bsó com\b|\bapenas com\b|\ba partir\b|\bpor isso\b|\bde cabeça\b|\bà primeira\b|\bentão vou\b",
    ),
    "it": Grammar(
        "non poss|non potr|non dev|non vogl|non intend|non sono|non è |non mi |non ti |non vi |non risolv|non rispond|non tratt|non forn|non do |non darò|non offr|non riesc|non sapr|non rientr|non occup|non c'|non ci |non verr|isco non|irei non|nessuna |alcuna |impossibile|incapace|rifiut|declin|asteng|astener|respinger|linee guida",
        r"\bnon (?:\w+ )?(?:posso|possiamo|potrò|potrei|devo|voglio|intendo|sono (?:in grado|autorizzat|capace|dispost)|è (?:possibile|permesso|consentito)|risolvo|rispondo|tratto|fornisco|do\b|darò|offro|riesco|saprei|rientra|mi occupo|occupo)|\bpreferi\w+ non\b|\bimpossibile (?:per me|risponder|risolver|aiutar|dar)|\bmi è (?:\w+ )?impossibile|\bincapace di",
        r"\baiut|\bassist|d'aiuto|esser\w* util",
        r"rispond|risolv|\bdar(?:e|ti|vi|le|ne)?\b|\bdarò\b|fornir|fornisc|offr|continu|prosegu|proced|soddisf|accogli|complet|\bdire\b|\bdirti|indic|\btratt|svolg|rivel|comunic|affront|\bfar(?:e|lo)\b|occup",
        r"domand|enigm|indovinell|problem|compit|richiest|eserciz|rispost|soluzion|risultat|\bquest[oaie]\b|\bciò\b|\btema\b|\bgener[ei]\b|\btip[oi]\b|quesit|rompicap|\bne\b|\blo\b",
        r"\brifiuto\b|\brifiutar|rifiutiamo|\bdeclino\b|\bdeclinar|mi asteng|astener|respingo|respinger",
        r"\b(?:nessuna?|alcuna?) (?:\w+ )?(?:risposta|soluzione|risultato|aiuto|valore)|\bnon (?:c'è|ci sarà|verrà data) (?:\w+ )?(?:risposta|soluzione|risultato)?",
        r"\bdar|\bdat|fornit|offert|possibil|disponibil|da parte mia|da me|ci sarà|offr",
        r"\b(?:mie|nostre|le) (?:\w+ )?(?:linee guida|regole|istruzioni|direttive|norme)\b.*(?:\bnon\b|viet|imped|proib)",
        r"mi dispiace|spiacente|purtroppo|scus|perdon|mi rincresce",
        r"direttamente|\bsubito\b|\bancora\b|\bsenza\b|\bprima\b|\bsolo con\b|\bda sol[oaie]\b|\ba partire\b|\bquindi\b|\bperciò\b|\ba mente\b|\ba occhio\b",
    ),
    "nl": Grammar(
        "niet|geen|onmogelijk|weiger|afwij|wijs|bedank|richtlijn|afslaan|ervan af|er van af",
        r"(?=.*\b(?:ik|mij|me|wij|ons)\b)(?=.*\b(?:kan|kunnen|mag|mogen|zal|zou|wil|ben|is|beantwoord|behandel|geef|los|help|lever|doe|lukt|moet)\b)(?=.*\b(?:niet|geen|onmogelijk|nooit|niets|buiten)\b)",
        r"\bhelpen\b|\bhelp\b|bijstaan|assisteren|van dienst",
        r"beantwoord|\bantwoorden|oplossen|\blos\b|\bgeven\b|\bgeef\b|bieden|leveren|verstrekken|doorgaan|verdergaan|verder gaan|uitvoeren|voldoen|ingaan|behandel|\bzeggen|noemen|vertellen|verwerken|meewerken|\bdelen\b|\bdoen\b",
        r"vraag|vragen|puzzel|raadsel|opgave|\btaak|taken|verzoek|probleem|oefening|antwoord|oplossing|uitkomst|resultaat|\bdit\b|\bdat\b|\bhier(?:bij|mee|op|aan)?\b|\bdaar(?:bij|mee|op|aan)?\b|onderwerp|\bsoort|\bje\b|\bu\b|\bzulke\b",
        r"\bweiger\b|\bweigeren\b|\bafwijzen\b|af te wijzen|\bwijs\b.*\baf\b|\bafslaan\b|\bsla\b.*\baf\b|\bbedank\b|\bzie\b.*\baf\b|\bafzien\b",
        r"\bgeen (?:\w+ )?(?:antwoord|oplossing|uitkomst|resultaat|waarde)",
        r"\bgeef|geven|gegeven|bieden|geboden|mogelijk|beschikbaar|van mij|leveren|krijgen|verstrekt|volgen",
        r"\b(?:mijn|onze|de) (?:\w+ )?(?:richtlijnen|regels|instructies|voorschriften)\b.*(?:\bniet\b|\bgeen\b|verbied)",
        r"\bsorry\b|\bspijt\b|helaas|excuses|neem me niet kwalijk",
        r"\bdirect\b|\bmeteen\b|\bnog niet\b|\bzonder\b|\bvoordat\b|\balleen\b|\bvanuit\b|\bdus\b|\bdaarom\b|\buit het hoofd\b|\bin één keer\b",
    ),
    "ru": Grammar(
        "не мог|не мож|не смо|не буд|не стан|не вправе|не име|не в сос|не в сил|не готов|не спос|не хо|не соб|не реш|не отв|не даю|не дам|не обс|не рас|не раз|не поз|не зан|не бер|не дав|не пос|предпо|лучше не|нельзя|невозможно|запрещ|отказ|отклон|воздерж|никак|правила|нет ответа|ответа не",
        r"\b(?:я|мне|мной|мною|меня|мы|нам)\b.*\b(?:не (?:\w+ )?(?:могу|можем|смогу|сможем|буду|стану|вправе|имею права|в состоянии|в силах|готов\w*|способ\w+|хочу|хотел\w*|собираюсь|решаю|отвечаю|даю|дам|обсуждаю|рассматриваю|разреш\w+|позволен\w*|занимаюсь|берусь)|нельзя|невозможно|запрещен\w*|запрещено)|\b(?:не (?:могу|можем|смогу|вправе|буду|стану|в состоянии|имею права|берусь|решаю|отвечаю))\b|\bпредпо\w+ не\b|\bлучше не (?:буду|стану|отвеч)",
        r"помо(?:чь|гу|гать|жем|щь)|содейств",
        r"отвеч|ответить|реш(?:ить|ать|аю|у|ении|ением|ения)\b|\bда(?:ть|вать|м|ю)\b|предостав|предлож|продолж|выполн|обсужд|назва|назов|сообщ|назыв|рассматр|разбир|обработ|вычисл|раскры|подсказ|сказать|приним|решени[ея]м? заним",
        r"вопрос|задач|загадк|головолом|запрос|просьб|задани|упражнени|ответ|решени|результат|\bэто\w*|\bэтим|\bтак(?:ие|их|ого|ими)\b|\bтем[уы]\b|\bвам\b|\bтебе\b|\bвас\b",
        r"отказываюсь|отказаться|отказываться|\bотказ\b|отклоняю|отклонить|воздерж(?:усь|аться|ись)|уклон(?:яюсь|иться)",
        r"\b(?:никакого|никаких|никакой) (?:\w+ )?(?:ответ|решени|результат)|\b(?:ответа|решения|результата)\b.*\bне (?:будет|дам|последует)|\b(?:ответ|решение|результат)\b.*\bне (?:будет|может быть)",
        r"\bне\b|дам|дать|будет|предостав",
        r"\b(?:мои|наши|правила|инструкции|политика)\b.*\b(?:не (?:позвол|разреш)|запрещ)",
        r"извин|сожал|прости|\bувы\b",
        r"\bсразу\b|напрямую|\bпока\b|\bещё\b|\bеще\b|\bбез\b|\bпрежде\b|\bтолько\b|\bпоэтому\b|\bв уме\b|\bодн(?:ой|им)\b",
    ),
    "zh": Grammar(
        "不能|无法|没法|没办法|不可以|不会|不便|不愿|不想|不打算|不处理|不回答|不解答|不提供|允许|无权|拒绝|恕|帮不|无能为力|爱莫能助|婉拒|谢绝|不作答|没有答案|不可能|不方便|不给",
        r"不能(?!用|使)|帮不|无法|没法|没办法|不可以|不会|不便|不方便|不愿|不想|不打算|不处理|不回答|不解答|不提供|不作答|不被允许|不允许|无权|恕|无能为力|爱莫能助|不给",
        r"帮|协助|无能为力|爱莫能助",
        r"回答|解答|解决|提供|给出|处理|完成|继续|告诉|作答|答复|回复|求解|满足|透露|说明答案|做|解出|解这|解该|给您|给你",
        r"问题|题|谜|请求|任务|要求|答案|结果|解答|忙|您|你|这个|此类",
        r"拒绝|婉拒|谢绝|回绝|放弃回答",
        r"(?:没有|任何|无)(?:答案|结果|解答)|答案(?:不会|无法)",
        r"给|提供|可|能|会",
        r"(?:准则|规定|政策|规则|指南).*(?:不允许|禁止|不许|不能)",
        r"抱歉|对不起|遗憾|不好意思|请原谅|请谅解",
        r"直接|立刻|马上|还不|之前|单凭|仅凭|只靠|只用|所以我|因此|口算",
    ),
}
_RE = {lang: Grammar(*(re.compile(p) for p in g)) for lang, g in GRAMMARS.items()}


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for lang, g in GRAMMARS.items():
        for cue in g.cues.split("|"):
            a.add_word(cue, (*a.get(cue, ()), lang))
    a.make_automaton()
    return a


_CUES = _automaton()
_STOP = re.compile(r"[.!?…]+(?=[\s\"'”»)\]]|$)|[。！？\n;；]")
_CLAUSE = re.compile(r"[,，、:：()（）]|\s[-–—]+\s")
_BOX = re.compile(r"\\boxed\{([^{}]*)\}")
_ANSWER = re.compile(r"(?<!\w)(?:answer|antwort|réponse|respuesta|resposta|risposta|antwoord|ответ|答案)\w*\s*(?:is|ist|est|es|é|è)?\s*[:：=][ \t]*([^\n]*)")
# Words for an answer.
_NOUNS = ahocorasick.Automaton()
for _noun in ("answer", "antwort", "réponse", "respuesta", "resposta", "risposta", "antwoord", "ответ", "答案"):
    _NOUNS.add_word(_noun, len(_noun))
_NOUNS.make_automaton()
#: words of a clause that is all apology and negation, and words after a limited method that go on with it
BARE, ON = 7, 8
#: words of a clause that an inserted remark has cut off from its verb
SHORT = 3
# Contents of a box that say there is no answer.
_NO_VALUE = re.compile(
    r"^\s*(?:|[-–—.…\s]+|none|null|nil|n/?a|nan|unknown|tbd|todo|empty|nothing|\?+|no (?:\w+ )?(?:answer|solution|result|response|comment)|(?:i )?(?:am )?(?:unable|cannot|can't|can not|won't|will not)\b.*|(?:i )?(?:refus|declin|abstain)\w*.*|not (?:able|answer|allowed|permitted|provided|given)\w*.*"
    r"|keine? (?:antwort|lösung|ergebnis)|abgelehnt|verweigert|unbeantwortet|aucune? (?:réponse|solution)|refusée?|sin respuesta|ninguna|rechazad\w+|rehusad\w+|sem resposta|nenhuma|recusad\w+|nessuna risposta|rifiutat\w+|geen antwoord|geweigerd|нет ответа|отказ\w*|без ответа|无|无答案|拒绝(?:回答|作答|解答)?|无法(?:回答|作答|解答|确定)?|不能回答)[\s.。!！]*$"
)
_DECLINED = re.compile(r"\b(?:unable|cannot|can't|can not|won't|will not|refus|declin|abstain|not (?:able|answer|allowed|permitted)|no (?:\w+ )?(?:answer|solution|response|comment))|keine? antwort|abgelehnt|verweigert|aucune réponse|refusé|sin respuesta|rechazad|sem resposta|recusad|nessuna risposta|rifiutat|geen antwoord|geweigerd|нет ответа|отказ|без ответа|拒绝|无法|不能回答")


#: German infinitives stand in a clause of their own
_OPEN = re.compile(r"(?:in der lage|möglich|außerstande|ausserstande|befugt|imstande|berechtigt|bereit|erlaubt|gestattet)\s*$")


def _plain(text: str) -> str:
    return text.lower().replace("’", "'").replace("\u00a0", " ").replace("\u202f", " ")


def no_value(content: str) -> bool:
    """Whether what a box or an answer line holds is no value but a blank, a placeholder or a refusal."""
    return bool(_NO_VALUE.match(_plain(content).strip()))


def says_no(content: str) -> bool:
    """Whether the content of a box declines to answer."""
    s = _plain(content).strip()
    return bool(_DECLINED.search(s)) and no_value(s)


def _refuses(g: Grammar, sentence: str, before: str, last: bool) -> bool:
    if not (g.neg.search(sentence) or g.refuse.search(sentence) or g.nothing.search(sentence) or g.policy.search(sentence)):
        return False
    sorry = bool(g.sorry.search(sentence) or g.sorry.search(before))
    if g.policy.search(sentence) and (g.verb.search(sentence) or g.helps.search(sentence) or sorry or g.obj.search(sentence)):
        return True
    parts = [p for p in _CLAUSE.split(sentence) if p and not p.isspace()]
    # an inserted remark parts the negation from its verb: the clause goes on behind it
    joined = parts + [f"{a} {x}" for i, a in enumerate(parts) if len(a.split()) <= SHORT or _OPEN.search(a) for x in parts[i + 1 : i + 3]]
    for p in joined:
        if g.nothing.search(p) and g.give.search(p):
            return True
        helps, verb, obj = g.helps.search(p), g.verb.search(p), g.obj.search(p)
        if g.refuse.search(p) and (helps or verb or obj or sorry):
            return True
        if g.neg.search(p) and (helps or (verb and (obj or sorry or (last and len(parts) == 1 and len(p.split()) <= BARE))) or (g.sorry.search(sentence) and len(p.split()) <= BARE and len(p) < 60 and p is parts[-1])):
            return True
    return False


def _last_value(low: str) -> int:
    """Where the last stated value of ``low`` ends, 0 without one."""
    at = 0
    for end, n in _NOUNS.iter(low):
        m = _ANSWER.match(low, end + 1 - n)
        if m and not no_value(m[1]):
            at = m.end()
    i = len(low)
    while (i := low.rfind("\\boxed{", at, i)) >= 0:
        m = _BOX.match(low, i)
        if m and not no_value(m[1]):
            return m.end()
    return at


def declines(text: str) -> bool:
    """Whether ``text`` declines its task, in any of the languages above; what was declined before the last stated value is withdrawn."""
    low = _plain(text)
    low = low[_last_value(low) :]
    if any(says_no(m[1]) for m in _BOX.finditer(low)):
        return True
    hits = list(_CUES.iter(low))
    if not hits:
        return False
    stops = [m.end() for m in _STOP.finditer(low)]
    seen: dict[int, set[str]] = {}
    for end, langs in hits:
        seen.setdefault(bisect_right(stops, end), set()).update(langs)
    for i in seen:
        a, b = (stops[i - 1] if i else 0), (stops[i] if i < len(stops) else len(low))
        before = low[stops[i - 2] if i > 1 else 0 : a]
        for lang in seen[i]:
            g = _RE[lang]
            # a text that goes on after it has excluded one way only
            m = g.limit.search(low, a, b)
            limited = m and (len(low[m.end() :].split()) > ON or (lang == "zh" and len(low) - m.end() > 2 * ON))
            if not limited and _refuses(g, low[a:b], before, not low[b:].strip()):
                return True
    return False
