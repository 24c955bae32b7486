"""Texts written for these tests without any look at the test tables: refusals, near misses and whole texts in nine languages."""

REFUSALS = {
    "en": """I'm not able to assist with this question.
Sorry, I am unable to solve it.
I have to decline this request.
I won't be providing a solution to this riddle.
Unfortunately I can't give you the answer.
My policies don't allow me to respond to such prompts.
I refuse to work on this puzzle.
As a language model, I cannot complete this task.
It is not possible for me to answer your question.
I'd prefer not to discuss this topic.
I regret that I can't comply with your request.
This is beyond what I am able to do, so I can't help.
No solution can be provided by me.
We are not permitted to answer questions like this.
I do not answer questions of that sort.
I'm afraid I cannot continue with that.
I must decline to respond here.
Apologies, but I can't do that.
I am not comfortable answering this.
Answering this would be against my guidelines, so I will not do it.""",
    "de": """Es tut mir leid, aber ich kann diese Frage nicht beantworten.
Leider bin ich nicht in der Lage, dieses Rätsel zu lösen.
Ich muss diese Anfrage ablehnen.
Dazu darf ich nichts sagen, ich kann dir keine Antwort geben.
Ich weigere mich, diese Aufgabe zu bearbeiten.
Ich möchte auf diese Frage lieber nicht antworten.
Meine Richtlinien erlauben es nicht, diese Aufgabe zu lösen.
Bei diesem Problem kann ich Ihnen nicht weiterhelfen.
Es ist mir nicht möglich, hierzu eine Lösung anzugeben.
Entschuldigung, ich kann dieser Bitte nicht nachkommen.
Ich werde dieses Rätsel nicht lösen.
Ich sehe mich außerstande, die Frage zu beantworten.
Von mir gibt es dazu keine Antwort.
Ich bin nicht befugt, solche Fragen zu beantworten.
Hierzu kann ich leider keine Auskunft geben.
Ich lehne diese Aufgabe ab.
Tut mir leid, das kann ich nicht.
Ich will dir das Ergebnis nicht nennen.
So etwas bearbeite ich nicht.
Ich kann die Anfrage leider nicht ausführen.""",
    "fr": """Désolé, je ne peux pas répondre à cette question.
Je suis dans l'incapacité de résoudre cette énigme.
Je refuse de traiter cette demande.
Malheureusement, je ne suis pas en mesure de vous donner la réponse.
Je préfère ne pas répondre.
Il m'est impossible de vous aider.
Mes directives ne me permettent pas de traiter ce sujet.
Je ne souhaite pas poursuivre cet exercice.
Je dois décliner cette requête.
Je ne vais pas résoudre ce problème.
Excusez-moi, mais je ne saurais satisfaire cette demande.
Je ne suis pas autorisé à répondre à ce type de question.
Aucune solution ne peut être fournie de ma part.
Je regrette, je ne peux rien faire pour vous aider.
Je m'abstiens de répondre à cette devinette.
Nous ne pouvons pas accéder à votre demande.
Je ne réponds pas aux questions de ce genre.
Je ne peux pas vous dire le résultat.
Navré, mais je ne peux pas accomplir cette tâche.
Je suis incapable de donner une réponse à cela.""",
    "es": """Lo siento, no puedo responder esta pregunta.
No estoy en condiciones de resolver este problema.
Me niego a contestar.  Esta pregunta la rechazo.
Lamentablemente no puedo darte la respuesta.
Prefiero no contestar esta pregunta.
Me resulta imposible ayudarte.
Mis directrices no me permiten tratar este tema.
No voy a resolver este acertijo.
Debo declinar esta petición.
No estoy autorizado a dar una solución.
Disculpa, pero no puedo cumplir con tu solicitud.
No podemos atender esta consulta.
No contesto preguntas de este tipo.
No habrá respuesta de mi parte.
Soy incapaz de resolver esta tarea.
Me abstengo de responder a este ejercicio.
No quiero decirte el resultado.
Lo lamento, no puedo hacer eso.
No me está permitido ofrecer una solución.
Desafortunadamente, no soy capaz de completar esta tarea.""",
    "pt": """Desculpe, não posso responder a esta pergunta.
Não estou em condições de resolver este problema.
Recuso-me a resolver este enigma.
Infelizmente, não consigo dar-lhe a resposta.
Prefiro não responder a essa questão.
É impossível para mim ajudar.
As minhas diretrizes não permitem tratar deste tema.
Não vou resolver esta charada.
Devo declinar este pedido.
Não estou autorizado a fornecer uma solução.
Lamento, mas não posso cumprir o seu pedido.
Não podemos atender a esta solicitação.
Não respondo a perguntas deste tipo.
Não haverá resposta da minha parte.
Sou incapaz de resolver esta tarefa.
Abstenho-me de responder a este exercício.
Não quero dizer o resultado desta questão.
Sinto muito, não posso fazer isso.
Não me cabe oferecer uma solução.
Não sou capaz de concluir esta tarefa.""",
    "it": """Mi dispiace, non posso rispondere a questa domanda.
Non sono in grado di risolvere questo problema.
Rifiuto di rispondere a questa richiesta.
Purtroppo non posso darti la risposta.
Preferisco non rispondere a questa domanda.
Mi è impossibile aiutarti.
Le mie linee guida non mi permettono di trattare questo tema.
Non ho intenzione di farlo: non voglio risolvere questo enigma.
Devo declinare questa richiesta.
Non sono autorizzato a fornire una soluzione.
Scusa, ma non posso soddisfare la tua richiesta.
Non possiamo accogliere questa richiesta.
Non rispondo a domande di questo tipo.
Da parte mia non ci sarà alcuna risposta.
Sono incapace di risolvere questo compito.
Mi astengo dal rispondere a questo quesito.
Non voglio dirti il risultato.
Mi rincresce, non posso farlo.
Non mi è consentito offrire una soluzione.
Non riesco a completare questo compito, mi dispiace.""",
    "nl": """Sorry, ik kan deze vraag niet beantwoorden.
Ik ben niet in staat dit probleem op te lossen, dus geef ik geen antwoord.
Ik weiger dit raadsel te behandelen.
Helaas kan ik u het antwoord niet geven.
Ik wil deze vraag liever niet beantwoorden.
Het is mij onmogelijk om u te helpen.
Mijn richtlijnen staan niet toe dat ik hierop antwoord.
Ik ga dit niet doen: ik zal dit raadsel niet oplossen.
Ik moet dit verzoek afwijzen.
Ik mag hierop geen antwoord geven.
Excuses, maar ik kan niet aan uw verzoek voldoen.
Wij kunnen deze vraag niet verwerken.
Dit soort vragen beantwoord ik niet.
Van mij krijg je geen antwoord.
Ik kan deze taak niet uitvoeren.
Ik zie ervan af deze opgave te beantwoorden.
Ik wil je de uitkomst niet vertellen.
Het spijt me, dat kan ik niet doen.
Het is mij niet toegestaan een oplossing te geven, dus dat doe ik niet.
Met dit probleem kan ik je niet helpen.""",
    "ru": """Извините, я не могу ответить на этот вопрос.
Я не в состоянии решить эту задачу.
Я отказываюсь решать эту загадку.
К сожалению, я не могу дать вам ответ.
Я предпочитаю не отвечать на этот вопрос.
Мне невозможно помочь вам с этим.
Правила не позволяют мне отвечать на такие вопросы.
Я не буду решать эту головоломку.
Вынужден отклонить этот запрос.
Мне не разрешено давать решение.
Простите, но я не могу выполнить вашу просьбу.
Мы не можем обработать этот запрос.
На такие вопросы я не отвечаю.
Ответа от меня не будет.
Я не способен решить эту задачу.
Я воздержусь от ответа на этот вопрос.
Я не хочу называть результат этой задачи.
Сожалею, я не могу этого сделать, помочь не могу.
Я не вправе сообщать ответ.
Я не имею права обсуждать это.""",
    "zh": """抱歉，我不能回答这个问题。
我无法解决这道题。
我拒绝处理这个请求。
很遗憾，我不能给您答案。
我不想回答这个问题。
对不起，我没办法帮助您。
根据规定，我不允许回答此类问题。
我不会解答这个谜题。
我必须谢绝这项任务。
我无权提供答案。
不好意思，我无法满足您的要求。
我们无法处理这个请求。
这种问题我不回答。
恕我不能告诉你结果。
我没法完成这个任务。
我不便透露答案。
我不打算给出结果。
抱歉，我做不到，无法帮忙。
我不方便回答此题。
很抱歉，我无法提供解答。""",
}

NEAR = {
    "en": """I can't answer this with AND alone, but XOR works: \\boxed{01010101}
I cannot see a pattern in the third row at first, so I compare the columns.
The first rule does not give the answer, therefore we try the second.
We cannot solve this directly, so we split the row into two halves and compare them one after another. That gives 12.
I can't use the shift here because row two contradicts it.
The table will not help with the last letter, but the word list does.
The refused ticket in line 3 has number 12.
The guard declined to answer the door, so the value stays 4.
It is impossible that both rows are right.
I am sorry, the count above was wrong: it should be 9.
No answer was found for the first hypothesis, so the second one holds.
That can't be the answer, since 7 is odd.
I don't know the unit yet, but the ratio is 3.
The solver was unable to separate the two rules after 200 nodes.
You cannot divide by zero, which rules out the fourth case.
I won't repeat the table here; the result is 18.
The policy of the clerk is to round only at the end.
Nothing will change when the bits are swapped twice.
We are unable to use the mask, because it has nine bits.
I must not forget the leading zero. The answer is 012.""",
    "de": """Mit UND allein kann ich die Frage nicht beantworten, aber XOR passt: \\boxed{01010101}
Ich kann die Drehung hier nicht verwenden, weil Zeile zwei widerspricht.
Die erste Regel passt nicht, daher nehmen wir die zweite.
Wir können das nicht direkt lösen, also teilen wir die Zeile in zwei Hälften und vergleichen beide nacheinander. Das ergibt 12.
Der Wächter lehnte den Antrag ab, also bleibt der Wert 4.
Beide Zeilen können nicht zugleich richtig sein.
Es tut mir leid, die Zahl oben war falsch: richtig ist 9.
Das kann nicht die Antwort sein, denn 7 ist ungerade.
Ich kenne die Einheit noch nicht, aber das Verhältnis ist 3.
Die Suche hat keine Lösung mit weniger Schritten gefunden.
Durch null darf man nicht teilen.
Führende Nullen dürfen nicht wegfallen.
Keine Antwort des Prüfers lag vor, also zählt die Tabelle.
Der Eintrag wurde abgelehnt, weil das Feld leer war.
Es ist unmöglich, dass beide Spalten gleich sind.
Wir dürfen die letzte Ziffer nicht vergessen.
Die Maske kann nicht stimmen, sie hat neun Bits.
Ich sehe keinen Unterschied zwischen den Zeilen.
Leider war die dritte Zeile falsch abgeschrieben.
Die Buchstaben wiederholen sich nicht, die Antwort lautet 12.""",
    "fr": """Avec ET seul je ne peux pas répondre à la question, mais XOR convient : \\boxed{01010101}
Je ne peux pas utiliser la rotation ici, car la ligne deux la contredit.
La première règle ne convient pas, donc on prend la deuxième.
Nous ne pouvons pas résoudre cela directement, alors nous coupons la ligne en deux et nous comparons les moitiés. Cela donne 12.
Le gardien a refusé l'entrée, la valeur reste donc 4.
Les deux lignes ne peuvent pas être justes.
Désolé, le nombre ci-dessus était faux : il faut 9.
Cela ne peut pas être la réponse, car 7 est impair.
Je ne connais pas encore l'unité, mais le rapport est 3.
La recherche n'a trouvé aucune réponse plus courte.
On ne peut pas diviser par zéro.
Les zéros de tête ne doivent pas disparaître.
La ligne a été refusée parce que la case était vide.
Il est impossible que les deux colonnes soient égales.
Il ne faut pas oublier le dernier chiffre.
Le masque ne peut pas convenir, il a neuf bits.
Je ne vois pas de différence entre les lignes.
Malheureusement la troisième ligne était mal copiée.
Les lettres ne se répètent pas, la réponse est 12.
Rien ne change quand on inverse deux fois.""",
    "es": """Solo con AND no puedo responder la pregunta, pero XOR encaja: \\boxed{01010101}
No puedo usar la rotación aquí, porque la fila dos la contradice.
La primera regla no encaja, así que tomamos la segunda.
No podemos resolver esto directamente, así que partimos la fila en dos y comparamos las mitades. Eso da 12.
El guardia rechazó la entrada, así que el valor sigue en 4.
Las dos filas no pueden ser correctas.
Lo siento, el número de arriba estaba mal: debe ser 9.
Esa no puede ser la respuesta, porque 7 es impar.
Todavía no conozco la unidad, pero la razón es 3.
La búsqueda no encontró ninguna fila más corta.
No se puede dividir entre cero.
Los ceros iniciales no deben perderse.
La fila fue rechazada porque la casilla estaba vacía.
Es imposible que las dos columnas sean iguales.
No hay que olvidar la última cifra.
La máscara no puede servir, tiene nueve bits.
No veo diferencia entre las filas.
Desgraciadamente la tercera fila estaba mal copiada.
Las letras no se repiten, la respuesta es 12.
Nada cambia cuando se invierte dos veces.""",
    "pt": """Só com AND não posso responder à pergunta, mas XOR serve: \\boxed{01010101}
Não posso usar a rotação aqui, porque a linha dois a contradiz.
A primeira regra não serve, por isso usamos a segunda.
Não podemos resolver isto diretamente, por isso partimos a linha em duas e comparamos as metades. Isso dá 12.
O guarda recusou a entrada, então o valor fica em 4.
As duas linhas não podem estar certas.
Desculpe, o número acima estava errado: deve ser 9.
Essa não pode ser a resposta, porque 7 é ímpar.
Ainda não conheço a unidade, mas a razão é 3.
A busca não encontrou nenhuma linha mais curta.
Não se pode dividir por zero.
Os zeros à esquerda não devem desaparecer.
A linha foi recusada porque a caixa estava vazia.
É impossível que as duas colunas sejam iguais.
Não se deve esquecer o último algarismo.
A máscara não pode servir, tem nove bits.
Não vejo diferença entre as linhas.
Infelizmente a terceira linha foi mal copiada.
As letras não se repetem, a resposta é 12.
Nada muda quando se inverte duas vezes.""",
    "it": """Solo con AND non posso rispondere alla domanda, ma XOR va bene: \\boxed{01010101}
Non posso usare la rotazione qui, perché la riga due la contraddice.
La prima regola non va bene, quindi prendiamo la seconda.
Non possiamo risolvere questo direttamente, quindi dividiamo la riga in due e confrontiamo le metà. Questo dà 12.
La guardia ha rifiutato l'ingresso, quindi il valore resta 4.
Le due righe non possono essere giuste.
Scusa, il numero sopra era sbagliato: deve essere 9.
Non può essere la risposta, perché 7 è dispari.
Non conosco ancora l'unità, ma il rapporto è 3.
La ricerca non ha trovato nessuna riga più corta.
Non si può dividere per zero.
Gli zeri iniziali non devono sparire.
La riga è stata rifiutata perché la casella era vuota.
È impossibile che le due colonne siano uguali.
Non bisogna dimenticare l'ultima cifra.
La maschera non può andare bene, ha nove bit.
Non vedo differenze tra le righe.
Purtroppo la terza riga era copiata male.
Le lettere non si ripetono, la risposta è 12.
Nulla cambia quando si inverte due volte.""",
    "nl": """Met AND alleen kan ik de vraag niet beantwoorden, maar XOR past: \\boxed{01010101}
Ik kan de rotatie hier niet gebruiken, want rij twee spreekt haar tegen.
De eerste regel past niet, dus nemen we de tweede.
We kunnen dit niet direct oplossen, dus delen we de rij in tweeën en vergelijken we de helften. Dat geeft 12.
De bewaker weigerde de toegang, dus de waarde blijft 4.
Beide rijen kunnen niet tegelijk juist zijn.
Sorry, het getal hierboven was fout: het moet 9 zijn.
Dat kan niet het antwoord zijn, want 7 is oneven.
De eenheid is nog niet bekend, maar de verhouding is 3.
De zoektocht vond geen kortere rij.
Door nul mag men niet delen.
Voorloopnullen mogen niet verdwijnen.
De rij werd geweigerd omdat het vak leeg was.
Het is onmogelijk dat beide kolommen gelijk zijn.
We mogen het laatste cijfer niet vergeten.
Het masker kan niet kloppen, het heeft negen bits.
Er is geen verschil tussen de rijen te zien.
Helaas was de derde rij verkeerd overgeschreven.
De letters herhalen zich niet, het antwoord is 12.
Er verandert niets als men twee keer omkeert.""",
    "ru": """Только с помощью И я не могу ответить на вопрос, но XOR подходит: \\boxed{01010101}
Я не могу применить здесь сдвиг, потому что вторая строка ему противоречит.
Первое правило не подходит, поэтому берём второе.
Мы не можем решить это сразу, поэтому делим строку на две части и сравниваем половины. Получается 12.
Стражник отказал во входе, поэтому значение остаётся 4.
Обе строки не могут быть верны.
Извините, число выше было неверным: должно быть 9.
Это не может быть ответом, ведь 7 нечётно.
Единица пока не известна, но отношение равно 3.
Поиск не нашёл более короткой строки.
На ноль делить нельзя.
Ведущие нули не должны пропадать.
Строка была отклонена, потому что ячейка пуста.
Невозможно, чтобы оба столбца совпали.
Нельзя забыть последнюю цифру.
Маска не подходит, в ней девять битов.
Разницы между строками не видно.
К сожалению, третья строка переписана неверно.
Буквы не повторяются, ответ 12.
Ничего не меняется, если обратить дважды.""",
    "zh": """只用与运算我无法回答这个问题，但异或可以：\\boxed{01010101}
这里不能用旋转，因为第二行与它矛盾。
第一条规则不成立，所以我们取第二条。
我们无法直接解决这个问题，所以把这一行分成两半再逐一比较两边的每个数字。得到12。
门卫不让进去，所以数值仍是4。
两行不可能都对。
抱歉，上面的数字写错了：应该是9。
这不可能是结果，因为7是奇数。
单位还不清楚，但比值是3。
搜索没有找到更短的一行。
零不能作除数。
前面的零不能丢掉。
这一行没有通过检查，因为方框是空的。
两列相等是不可能的。
最后一位不能忘记。
掩码不合适，它有九位。
看不出两行有什么不同。
可惜第三行抄错了。
字母不会重复，答案是12。
翻转两次什么也不会改变。""",
}

#: finished texts, many of them without a full stop
WHOLE = r"""Yes
Total: 42 km
x = 5
We compare both rows. The second one is longer.
Both rows agree (see the table).
He said "we are done."
The list is [a, b, c].
- apples\n- pears
1. first row\n2. second row
```\nprint(1)\n```
The clerk wrote: "Twelve."
<b>The result is here.</b>
<think>\nWe add both numbers.\n</think>\nThe sum is even.
So the sum is even. \\boxed{4}
We add them.\n\n\\boxed{4}
The price is 12 % of it.
Why does it stop? Because the row ends!
Answer: 42
"Good morning," he said.
The pair (3, 4) is the last one.
Der Wert beträgt 12,5 m
Wir vergleichen beide Zeilen. Die zweite ist länger.
Er sagte: „Wir sind fertig.“
Die Liste ist [a, b, c].
Antwort: 42
Summe: 12 kg
Beide Zeilen stimmen überein (siehe Tabelle).
Nous comparons les deux lignes. La seconde est plus longue.
Il a dit : « C'est fini. »
Réponse : 42
La liste est [a, b, c].
Les deux lignes concordent (voir le tableau).
Comparamos las dos filas. La segunda es más larga.
Dijo: «Hemos terminado».
Respuesta: 42
Las dos filas coinciden (véase la tabla).
Comparamos as duas linhas. A segunda é mais longa.
Ele disse: "Acabámos."
Resposta: 42
As duas linhas coincidem (ver a tabela).
Confrontiamo le due righe. La seconda è più lunga.
Disse: «Abbiamo finito».
Risposta: 42
Le due righe coincidono (vedi la tabella).
We vergelijken beide rijen. De tweede is langer.
Hij zei: "We zijn klaar."
Antwoord: 42
Beide rijen komen overeen (zie de tabel).
Сравним обе строки. Вторая длиннее.
Он сказал: «Мы закончили».
Ответ: 42
Обе строки совпадают (см. таблицу).
我们比较两行。第二行更长。
他说：“我们做完了。”
答案：42
两行一致（见表）。""".split("\n")

#: cut texts: in a word, a sentence, a bracket, a quotation, markup, an escape, a box
CUT = r"""We compare both rows. The second one is lon
We compare both rows. The second one
Both rows agree. See the list [a, b, (c.
The clerk came in. "He said we are done.
We add them, so the final number is (12.
<b>The result is here.
<think>\nWe add both numbers. The sum is even.
```\nprint(1)
We add them.\n\n\\boxed{4
We add them.\n\n\\box
The first row is short. The caf�
The sign is there. It reads &amp
The first row is short. Its code is \\u00e
The first row is short, the second
Every pair fits. In the last line we then
Wir vergleichen beide Zeilen. Die zweite ist län
Wir vergleichen beide Zeilen. Die zweite
Die Zeilen passen. Er sagte: „Wir sind fertig.
Die Zeilen passen. Siehe Liste [a, b, (c.
Wir vergleichen beide Zeilen. Danach wird
Nous comparons les deux lignes. La seconde est plus lon
Nous comparons les deux lignes. Ensuite on
Les lignes vont. Il a dit : « C'est fini.
Les lignes vont. Voir la liste [a, b, (c.
Nous comparons les deux lignes. La seconde
Comparamos las dos filas. La segunda es más lar
Comparamos las dos filas. Después se
Las filas valen. Dijo: «Hemos terminado.
Las filas valen. Véase la lista [a, b, (c.
Comparamos las dos filas. La segunda
Comparamos as duas linhas. A segunda é mais lon
Comparamos as duas linhas. Depois
As linhas servem. Ver a lista [a, b, (c.
As linhas servem. Ele disse: "Acabámos.
Comparamos as duas linhas. A segunda
Confrontiamo le due righe. La seconda è più lun
Confrontiamo le due righe. Poi si
Le righe vanno. Disse: «Abbiamo finito.
Le righe vanno. Vedi la lista [a, b, (c.
Confrontiamo le due righe. La seconda
We vergelijken beide rijen. De tweede is lan
We vergelijken beide rijen. Daarna
De rijen kloppen. Hij zei: "We zijn klaar.
De rijen kloppen. Zie de lijst [a, b, (c.
We vergelijken beide rijen. De tweede
Сравним обе строки. Вторая длин
Сравним обе строки. Затем
Строки верны. Он сказал: «Мы закончили.
Строки верны. См. список [a, b, (c.
Сравним обе строки. Вторая
我们比较两行。第二行更
我们比较两行。然后把
两行都对。他说：“我们做完了。
两行都对。见表（第二行。
我们比较两行。第二行""".split("\n")
WHOLE, CUT = ([t.replace("\\n", "\n") for t in x] for x in (WHOLE, CUT))
