"""Stop words of several languages, in both normal forms, and how lists are put together."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LISTS = {
    "eng": "a about above after again against all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not now of off on once only or other our ours out over own same she should so some such than that the their theirs them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your yours",
    "fra": "à ai ainsi alors après as au aucun aussi autre aux avant avec avoir bon car ce cela celle celui ces cet cette ceux chaque comme comment d dans de des donc dont du elle elles en encore entre est et étaient était été être eu eux fait faire il ils j je l la le les leur leurs lui m ma mais me même mes moi mon n ne ni nos notre nous on ont ou où par pas peu peut plus pour pourquoi qu quand que quel quelle qui s sa sans se ses si sien son sont sous sur t ta te tes toi ton tous tout très tu un une vos votre vous y",
    "deu": "aber alle als also am an auch auf aus bei bin bis bist da damit dann das dass dein dem den der des dich die dies diese dieser dir doch du durch ein eine einem einen einer eines er es euch euer für gegen habe haben hat hatte hier hin hinter ich ihm ihn ihnen ihr ihre im in ist ja jede jeder jetzt kann kein keine können man mein mich mir mit muss nach nein nicht noch nun nur ob oder ohne schon sehr sein seine sich sie sind so solche sondern über um und uns unser unter vom von vor war waren was weil welche wenn wer wie wieder will wir wird wo zu zum zur zwischen",
    "spa": "a al algo algunas algunos ante antes aquel aquella aquí así aunque bajo bien cada como con contra cual cuando cuyo de del desde donde dos durante e el él ella ellas ellos en entre era eran es esa ese eso esta está están estas este esto estos fue fueron ha había han hasta hay la las le les lo los más me mi mientras muy nada ni no nos nosotros nuestra nuestro o os otra otro para pero poco por porque que qué quien se sea ser si sí siempre sin sino sobre son su sus también tan te tiene toda todo tu tus un una uno unos y ya yo",
    "ita": "a ad agli ai al alla alle allo anche ancora avere aveva c che chi ci cioè come con contro cui da dagli dai dal dalla dalle dallo degli dei del della delle dello di dove e è ed era erano essere fra già gli ha hanno ho i il in io la le lei li lo loro lui ma me mi mia mio molto ne negli nei nel nella nelle nello no noi non nostro o ogni per perché più po poi quale quando quanto quella quello questa questo se sei senza si sia siamo sono sta stata stato su sua sugli sui sul sulla sulle sullo suo te ti tra tu tuo tutti tutto un una uno vi voi vostro",
    "por": "a à ainda ao aos aquela aquele aquilo as até com como da das de dela dele depois do dos e é ela elas ele eles em entre era eram essa esse esta está este eu foi foram há isso isto já lhe lhes lo mais mas me mesmo meu minha muito na não nas nem no nos nós nossa nosso num numa o os ou para pela pelas pelo pelos por porque qual quando que quem são se sem ser seu seus só sua suas também te tem têm teu tu tua um uma você vocês",
    "rus": "а без более бы был была были было быть в вам вас весь во вот все всё всего всех вы где да даже для до его ее её если есть ещё же за здесь и из или им их к как ко когда которые который кто ли либо мне может мы на надо наш не него неё нет ни них но ну о об однако он она они оно от очень по под при с со так также такой там те тем то того тоже той только том ты у уже хотя чего чей чем что чтобы эта эти это этот я",
    "jpn": "の に は を た が で て と し れ さ ある いる も する から な こと として い や れる など なっ ない この ため その あっ よう また もの という あり まで られ なる へ か だ これ によって により おり より による ず なり られる において ば なかっ なく しかし について せ だっ その後 できる それ う ので なお のみ でき き つ における および いう さらに でも ら たり その他 に関する たち ます ん なら に対して",
    "zho": "的 一 不 在 人 有 是 为 以 于 上 他 而 后 之 来 及 了 因 下 可 到 由 这 与 也 此 但 并 个 其 已 无 小 我 们 起 最 再 今 去 好 只 又 或 很 亦 某 把 那 你 乃 它 吧 被 比 别 趁 当 从 得 打 凡 儿 尔 该 各 给 跟 和 何 还 即 几 既 看 据 距 靠 啦 另 么 每 嘛 拿 哪 您 凭 且 却 让 仍 啥 如 若 使 谁 虽 随 同 所 她 哇 嗡 往 些 向 沿 哟 用 咱 则 怎 曾 至 致 着 诸 自",
}


def both_forms(words) -> set[str]:
    """The words composed and decomposed (NFC and NFD): Spark can't normalise the text's side, so the list has either form."""
    return {unicodedata.normalize(form, w) for w in words for form in ("NFC", "NFD")}


def stopword_map(custom: dict[str, set[str]] | None = None, defaults: dict[str, set[str]] | None = None) -> dict[str, set[str]]:
    """Lists by language: a custom one takes the place of the default one, languages of either side are there."""
    base = {k: set(v.split()) for k, v in LISTS.items()} if defaults is None else defaults
    return {k: both_forms(v) for k, v in ({**base, **(custom or {})}).items()}


def stopword_frame(spark: SparkSession, lists: dict[str, set[str]]) -> DataFrame:
    """``(lang, word)``."""
    return spark.createDataFrame([(k, w) for k, v in sorted(lists.items()) for w in sorted(v)], "lang string, word string")


def stopword_column(lists: dict[str, set[str]], language: Column, default: str | None = None) -> Column:
    """The list of the language's stop words; of ``default`` where the language has none, else null."""
    table = F.create_map(*[x for k, v in sorted(lists.items()) for x in (F.lit(k), F.array(*[F.lit(w) for w in sorted(v)]))])
    found = F.try_element_at(table, language)
    return found if default is None else F.coalesce(found, F.try_element_at(table, F.lit(default)))
