"""Word lists that results depend on. Fixed values, in their natural order."""

from __future__ import annotations

# Function words by language.
FUNCTION_WORDS = {
    "en": "a an the and or but if of to in on at by for with from as is are was were be been being it its this that these those i you he she we they me my your our their what which who whom how when where why can could should would will do does did not no yes so than then there here about into over also any all per up out s t",
    "ru": "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из ему теперь когда даже ну вдруг ли если уже или ни быть был него до вас нибудь опять уж вам ведь там потом себя ничего ей может они тут где есть надо ней для мы тебя их чем была сам чтобы без будто чего раз тоже себе под будет ж тогда кто этот того потому этого какой совсем ним здесь этом один почти мой тем чтобы нее сейчас были куда зачем всех никогда можно при наконец два об другой хоть после над больше тот через эти нас про всего них какая много разве три эту моя впрочем хорошо свою этой перед иногда лучше чуть том нельзя такой им более всегда конечно всю между это сколько какие каков какая какое какую каких каково",
    "es": "el la los las un una unos unas de del al y o que en es son por para con sin se su sus lo como más qué cuál cuáles cuánto cuánta cómo dónde cuándo hay tiene tienen este esta estos estas ese esa usted ustedes le les mi",
    "fr": "le la les un une des du de et ou que qui en est sont par pour avec sans se sa son ses ce cette ces au aux ne pas plus quel quelle quels quelles combien comment où quand il elle ils elles vous nous on y a font fait",
    "de": "der die das den dem des ein eine einer eines einem und oder ist sind von zu mit für auf im in am an aus bei nicht wie was welche welcher welches wann wo viel viele es sie ich wir ihr hat haben wird werden gibt lautet",
    "it": "il lo la i gli le un uno una di del della dei delle e o che è sono per con su tra fra non più come quale quali quanto quanta dove quando ci si ha hanno fa al alla",
    "hi": "का के की को में से पर और या है हैं था थे क्या कैसे कब कहाँ कौन कितना कितनी कितने यह वह ये वे इस उस एक भी तो ही लिए आप हम",
    "ja": "は が を に の で と も へ か な ね よ です ます まし から まで ですか どの なに なん いく くら",
    "zh": "的 了 是 在 和 有 我 你 他 她 它 们 这 那 吗 呢 吧 啊 也 都 就 与 及 或 什么 多少 怎么 如何 哪些 是否 可以 我们 你们 他们 一个 这个 那个 没有 以及",
}
STOPWORDS = frozenset(w for ws in FUNCTION_WORDS.values() for w in ws.split())

# Words and letters that mark a Latin-script language.
LANGUAGE_MARKERS = {
    "en": "the is are what how which who why when where do does can you your of and to with for this that there",
    "es": "el la los las es qué cuál cuánto cuánta cómo dónde cuándo por para con una del hay tiene usted ustedes su sus y",
    "fr": "le la les est quel quelle quels quelles combien comment où quand pour avec une des du et vous nous au aux",
    "de": "der die das ist sind wie was welche welcher welches wann wo gibt es und mit für ein eine einen nicht ich sie",
    "it": "il lo la gli è sono qual quale quali quanto come dove quando per con una del della e che non ci",
}
LANGUAGE_LETTERS = {"es": "ñ¿¡", "de": "ßäöü", "fr": "çœêëîïôûùâ", "it": "ìò"}

# Beginnings and markers of questions.
QUESTION_STARTS = (
    "what", "how", "which", "when", "where", "why", "who", "is ", "are ", "do ", "does ", "can ", "could ", "should ", "что", "как", "какой", "какая",
    "какие", "каков", "сколько", "когда", "где", "почему", "зачем", "кто", "есть ли", "можно ли", "qué", "que ", "cuál", "cuánto", "cómo", "dónde",
    "cuándo", "quel", "quelle", "combien", "comment", "où", "quand", "was ", "wie ", "welche", "wann", "wo ", "gibt es", "qual", "quanto", "come ",
    "dove", "quando",
)
QUESTION_MARKERS = "吗 什么 多少 怎么 如何 哪 是否 能否 ですか ますか क्या कैसे कितना कितनी कौन".split()

# Replies in nine languages.
NOTHING_FOUND = {
    "ru": "В базе знаний нет информации об этом.", "en": "The knowledge base has no information about this.", "zh": "知识库中没有这方面的信息。",
    "es": "La base de conocimiento no tiene información sobre esto.", "hi": "नॉलेज बेस में इसकी कोई जानकारी नहीं है।", "fr": "La base de connaissances ne contient aucune information à ce sujet.",
    "de": "Die Wissensbasis enthält dazu keine Informationen.", "ja": "ナレッジベースにはこれに関する情報がありません。", "it": "La base di conoscenza non contiene informazioni su questo.",
}
NOTHING_ADDED = {
    "ru": "База знаний пока пуста. Загрузите документы, и я отвечу по ним.", "en": "The knowledge base is empty. Add some documents and I will answer from them.", "zh": "知识库目前是空的。请先上传文档，我会根据文档作答。",
    "es": "La base de conocimiento está vacía. Añade documentos y responderé a partir de ellos.", "hi": "नॉलेज बेस अभी खाली है। दस्तावेज़ जोड़ें, मैं उन्हीं के आधार पर जवाब दूँगा।", "fr": "La base de connaissances est vide. Ajoutez des documents et je répondrai à partir de ceux-ci.",
    "de": "Die Wissensbasis ist leer. Fügen Sie Dokumente hinzu, dann antworte ich auf deren Grundlage.", "ja": "ナレッジベースはまだ空です。ドキュメントを追加していただければ、その内容に基づいて回答します。", "it": "La base di conoscenza è vuota. Aggiungi dei documenti e risponderò in base a quelli.",
}
ECHO = {"ru": "(офлайн-демо) Вы написали: {text}", "zh": "（离线演示模式）您输入的是：{text}", "ja": "（オフラインデモ）入力内容：{text}", "hi": "(ऑफ़लाइन डेमो) आपने लिखा: {text}", "en": "(offline demo mode) You said: {text}"}
# Labels of a timeline section.
SECTION_LABELS = {
    "ru": ("На экране", "Речь"), "en": ("On screen", "Speech"), "zh": ("屏幕内容", "语音"), "es": ("En pantalla", "Voz"), "hi": ("स्क्रीन पर", "वाणी"),
    "fr": ("À l'écran", "Parole"), "de": ("Auf dem Bildschirm", "Sprache"), "ja": ("画面", "音声"), "it": ("Sullo schermo", "Parlato"),
}
SEARCH_WORDS = ("search", "knowledge base", "document", "find in", "найди", "поиск", "база знаний", "базе знаний", "документ", "搜索", "查找", "知识库", "文档")
