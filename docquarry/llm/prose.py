"""Ordinary prose of several languages, written for this package, that the model of prose (problem 8) is also fitted on."""

PROSE = """
The old house stood at the end of a narrow lane, and nobody had lived there since the war ended.
She opened the window because the room was warm, and then she sat down to write a long letter to her brother.
Most of the people who came to the market on Saturday bought bread, cheese and a few vegetables for the week.
When the rain stopped, the children ran out into the garden and played until it was too dark to see the ball.
He had never been to the sea before, so he stood on the beach for an hour and watched the waves come in.
The committee met twice last year, but it could not agree on how the money should be spent.
If you want to learn a language well, you must listen to it every day and speak it as often as you can.
Scientists have known for a long time that bees can tell one flower from another by its colour and its smell.
The train was late again, which meant that we missed our connection and had to spend the night in a small town.
In the north of the country the winters are long and cold, while in the south it hardly ever snows.
After the meeting she asked me whether I had read the report, and I had to admit that I had only looked at the first page.
There is no reason to believe that the plan will fail, although it will cost more than we expected.
The river rises in the hills to the west of the city and flows through several lakes before it reaches the coast.
Before you start, make sure that the machine is switched off and that nobody else is using it.
Many of the books in the library were given by a doctor who had travelled widely in his youth.
It took them almost three weeks to repair the bridge, and during that time all traffic had to go around the valley.
Our neighbours are very kind people, and they have often helped us with the animals when we were away.
The teacher explained the problem once more, but some of the students still did not understand what was being asked.
Although the company was founded only ten years ago, it already has offices in more than twenty countries.
What surprised us most was not the price of the meal but the time it took to arrive at our table.
Water boils at a lower temperature on a mountain because the pressure of the air is less than it is in the valley.
They walked for hours through the forest without meeting anyone, and in the evening they found a hut by a stream.
The museum is open every day except Monday, and entry is free for children under the age of twelve.
My grandfather used to say that a good story is worth more than a full purse, and I think he was right.
We do not know who built the tower or why it was left unfinished, but it has been a landmark for sailors ever since.
The doctor told him to rest for a week, to drink plenty of water and to come back if the pain did not go away.
As soon as the lights went out, everybody in the hall became quiet and the musicians began to play.
Prices have risen faster than wages in recent years, so many families have less to spend than they had before.
If the temperature falls below zero, the pipes may freeze, and in that case the water must be turned off at once.
He put the letter back into the drawer, locked it, and went downstairs as though nothing had happened.
从前有一位老人住在山脚下的小村子里，他每天早上都要走很远的路去河边打水。
因为下雨，我们没有去公园，而是在家里看了一个下午的书。
这座城市的历史很长，城墙是几百年前修的，现在已经成了有名的景点。
如果你想学好一门外语，就应该每天听一点、说一点，不要怕说错。
她把信放在桌子上，然后轻轻地关上门，走到院子里去了。
虽然这条路不太好走，但是从这里到火车站比走大路要近得多。
老师让我们把自己最难忘的一件事写下来，并且说明为什么忘不了。
科学家发现，这种鸟每年秋天都会飞到南方去过冬，第二年春天再飞回来。
会议开了三个小时，大家对怎样使用这笔钱还是有不同的看法。
奶奶做的饭菜虽然简单，可是我们每次都吃得很香，因为里面有家的味道。
他在那家工厂工作了二十多年，从学徒一直做到了车间主任。
夏天的晚上，孩子们在树下听爷爷讲故事，一直讲到月亮升起来。
为了保护环境，市政府决定在老城区限制汽车通行，同时增加公共汽车的班次。
我第一次看见大海的时候，站在沙滩上半天说不出话来。
医生告诉他要多休息、多喝水，如果一周以后还不舒服就再来检查。
这本书讲的是一个年轻人离开家乡到城里找工作的经历，读起来很真实。
随着生活水平的提高，越来越多的人开始注意饮食和运动对身体的影响。
火车晚点了两个小时，等我们到达的时候，天已经完全黑了。
图书馆里非常安静，只有翻书的声音和窗外的风声。
他说完以后，没有人回答，大家都低着头想自己的事情。
Das alte Haus stand am Ende einer schmalen Straße, und seit dem Krieg hatte niemand mehr darin gewohnt.
Wenn es im Winter stark schneit, fahren viele Leute lieber mit dem Zug als mit dem Auto in die Stadt.
Sie öffnete das Fenster, weil es im Zimmer zu warm war, und setzte sich dann an den Tisch, um einen Brief zu schreiben.
Der Arzt hat ihm gesagt, dass er sich eine Woche lang ausruhen und viel Wasser trinken soll.
Obwohl die Firma erst vor zehn Jahren gegründet wurde, hat sie schon in vielen Ländern ein Büro.
Nach der Sitzung fragte er mich, ob ich den Bericht gelesen hätte, und ich musste zugeben, dass ich nur die erste Seite kannte.
Die Kinder spielten im Garten, bis es so dunkel war, dass man den Ball nicht mehr sehen konnte.
Wir wissen nicht, wer den Turm gebaut hat, aber er ist seit langer Zeit ein Zeichen für die Schiffe auf dem Meer.
Auf dem Markt kauften die Leute Brot, Käse und Gemüse für die ganze Woche, und danach tranken sie noch einen Kaffee.
Es dauerte fast drei Wochen, bis die Brücke repariert war, und in dieser Zeit musste der Verkehr durch das Tal fahren.
La vieja casa estaba al final de una calle estrecha y nadie había vivido en ella desde hacía muchos años.
Cuando dejó de llover, los niños salieron al jardín y jugaron hasta que se hizo de noche.
El médico le dijo que tenía que descansar una semana y beber mucha agua, y que volviera si el dolor no se le quitaba.
Aunque la empresa es muy joven, ya tiene oficinas en más de veinte países y da trabajo a mucha gente.
Si quieres aprender bien una lengua, es necesario que la escuches todos los días y que hables con otras personas.
No sabemos quién construyó la torre ni por qué no la terminaron, pero es la más alta de toda la costa.
En el norte del país los inviernos son largos y fríos, mientras que en el sur casi nunca nieva.
La gente que iba al mercado los sábados compraba pan, queso y un poco de fruta para la semana.
La vieille maison se trouvait au bout d'une rue étroite, et personne n'y avait habité depuis la fin de la guerre.
Quand la pluie a cessé, les enfants sont sortis dans le jardin et ils ont joué jusqu'à la nuit.
Le médecin lui a dit de se reposer pendant une semaine et de revenir si la douleur ne passait pas.
Bien que l'entreprise soit jeune, elle a déjà des bureaux dans plus de vingt pays.
Nous ne savons pas qui a construit la tour, mais elle est un repère pour les marins depuis très longtemps.
Si vous voulez apprendre une langue, il faut l'écouter tous les jours et la parler le plus souvent possible.
Il treno era in ritardo e così abbiamo dovuto passare la notte in una piccola città vicino al mare.
Se vuoi imparare bene una lingua, devi ascoltarla tutti i giorni e parlare con le persone che la conoscono.
O comboio chegou tarde, e por isso tivemos de passar a noite numa cidade pequena que não conhecíamos.
Als het in de winter veel sneeuwt, gaan de mensen liever met de trein dan met de auto naar de stad.
Когда дождь кончился, дети вышли в сад и играли там до самого вечера, пока не стало совсем темно.
Мы не знаем, кто построил эту башню, но она уже давно служит знаком для кораблей, которые идут к берегу.
""".strip().splitlines()
