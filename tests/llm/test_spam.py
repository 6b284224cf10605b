"""Spam pages: families that are cases, ordinary pages that look alike."""

from __future__ import annotations

import pytest

from loomtrace.llm import spam

PROSE = "The gateway restores the session store when the lease expires. If the queue drains, the worker forwards what it finds there. You can ask the planner why it waits, but the answer is often late. "
GERMAN = "Der Gateway speichert den Verlauf nach dem Neustart. Wenn der Planer den Stapel kürzt, bleibt der andere Eintrag teuer. Niemand erwartet, dass er den Hinweis verwirft. "
CASES = {
    "keywords": "best chat bot, cheap voice clone, chat bot, token top-up, voice clone cheap, " * 8,
    "no separators": "AGENT HOSTING WEBHOOK RELAY AGENT HOSTING CHEAP " * 10,
    "bars": "top proxy pool | gpu rental | cron hosting | top proxy pool\n" * 8,
    "tags": "[optional tool result], [segment reader], [late tool result], [search hit], " * 6,
    "hashtags": "#stale-lease #cached-prefix #open-trace #orphan-run, #rate-limit, #draft-plan, #config-file, #user-reply, #route-planner " * 3,
    "links": "\n".join(f"{i}) quiet user reply >> https://wiki.example/{i}" for i in range(20)),
    "bbcode": "\n".join(f"[url=http://a.example/{i}]voice clone[/url]" for i in range(20)),
    "products": "\n".join(f"gpu rental (SKU {i}7) 12.99" for i in range(20)),
    "stuffed": "Looking for ai assistant? ai assistant here, ai assistant now! Our ai assistant is the ai assistant for ai assistant fans. " * 5,
    "look-alikes": "fаst сrоn hоsting; vоiсе сlоnе bеst; tоkеn tор-uр; " * 8,
    "hidden characters": "fa​st cr​on hosting; vo​ice clo​ne; " * 10,
    "french": "robot de chat pas cher | pack de prompts | hébergement agent en ligne | crédit jetons " * 8,
    "chinese": "显卡租用优惠, 最好聊天机器人, 智能体托管, 会话存储昂贵, " * 6,
    "mostly": PROSE + "buy agent hosting\nvoice clone free\ncheap proxy pool\nbest chat bot\n" * 12,
}
ORDINARY = {
    "prose": PROSE * 5,
    "german": GERMAN * 5,
    "chinese": "如果网关合并过期租约,另一个重试计数就会变得昂贵。为什么调度器要在夜间合并摘要页面?我们看到12次会话存储变得安静的情况。" * 4,
    "japanese": "こんにちは、セッションを再開します。" * 20,
    "russian": "Это обычный текст без списка слов, который никто не должен считать рекламой. " * 6,
    "described links": "\n".join(f"- [lease {i}](https://wiki.example/{i}): What the lease {i} is for and when it ends." for i in range(15)),
    "changelog": "\n".join(f"- fix: The gateway keeps the lease when it restarts. ([#{i}](https://code.example/p/{i}))" for i in range(15)),
    "options": "\n".join(f"| `--quiet-lease-{i}` | int | How long the worker waits for it. |" for i in range(15)),
    "log": "```\n" + "\n".join(f"2026-04-09T00:56:{i:02}Z WARN gateway: lease 59 still held, waiting" for i in range(40)) + "\n```",
    "code": "```python\n" + "x = [a, b, c, d, e, f, g]\n" * 30 + "```",
    "partly": PROSE * 3 + "\n\nTags: stale-lease, open-trace, cached-prefix\n",
    "less than half": PROSE * 4 + "buy agent hosting\nvoice clone free\ncheap proxy pool\nbest chat bot\n" * 4,
    "names spam": "“token top-up” sounds good, but the contract ends after 63 days. A colleague asked whether webhook relay would help us at night. " * 4,
    "empty": "", "blank": " \n\t​", "short": "<|endoftext|> a, b, c, d, e, f, g, h", "odd": "!!!" * 200, "one letter": "a" * 5_000,
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    assert spam.is_spam(spam.features(CASES[name])), spam.features(CASES[name])


@pytest.mark.parametrize("name", ORDINARY)
def test_ordinary(name):
    assert not spam.is_spam(spam.features(ORDINARY[name])), spam.features(ORDINARY[name])


def test_shares_are_shares():
    for text in [*CASES.values(), *ORDINARY.values()]:
        f = spam.features(text)
        assert all(0 <= f[n] <= 1 + 1e-9 for n in spam.SHARES[1:])


def test_rows(spark):
    rows = [(1, CASES["links"], "x"), (1, CASES["links"], "x"), (2, None, None), (3, "", None), (None, PROSE * 200, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, is_spam string")
    got = sorted(((r.doc_id, r.is_spam) for r in spam.page_features(docs).collect()), key=str)
    assert got == sorted([(1, True), (1, True), (2, False), (3, False), (None, False)], key=str)
    assert spam.page_features(docs.limit(0)).count() == 0


PAGE_CASES = {
    "one word": "Garde, c'est garde et toujours garde. Notre garde est le garde pour garde. garde ? Ici garde, encore garde ! " * 4,
    "one word, german": "Kanaladapter gesucht? Kanaladapter hier, Kanaladapter jetzt! Unser Kanaladapter ist das Kanaladapter für Kanaladapter. " * 4,
    "one word a sentence": "You want the hosting that lasts. We have hosting for you. It is hosting as you like it. There is no better hosting. Who needs hosting in the night?",
    "phrase a sentence": "You can buy a voice clone here. We sell the voice clone to all. There is a voice clone for your team. It was the voice clone that they like. Why not try our voice clone?",
    "dense": "gpu rental | chat bot | proxy pool | voice clone | cron hosting | The gateway restores it. | " * 3 + "gpu | bot | pool | clone | cron | relay",
}


@pytest.mark.parametrize("name", PAGE_CASES)
def test_page_shares(name):
    assert spam.is_spam(spam.features(PAGE_CASES[name])), spam.features(PAGE_CASES[name])


def test_page_shares_of_prose():
    f = spam.features(PROSE + "The gateway is slow. It was late when the gateway came back. We saw that the gateway was there. They had asked for it before the night, and the answer was there.")
    assert 0 < f["top_word_share"] < spam.FLOORS["top_word"] and f["top_gram_share"] == 0 and f["separator_density"] < spam.FLOORS["separators"] and f["stuffed_share"] == 0


SHARE_CASES = {
    "seven links": "\n".join(f"https://wiki.example/quiet/{i}/user/reply" for i in range(7)),
    "seven products": "\n".join(f"gpu rental model {i}7 monthly offer" for i in range(7)),
    "sentence between": ("buy agent hosting\nvoice clone free\ncheap proxy pool\nbest chat bot\ngpu rental\ncron hosting\nwebhook relay\nSee what we have.\n" * 3),
    "short page": "cheap gpu rental, best chat bot, free voice clone, proxy pool",
    "fullwidth": "显卡租用｜最好聊天机器人｜智能体托管【会话存储】优惠｜" * 5,
    "emoji": "🔥显卡租用🔥, 最好聊天机器人✨, 智能体托管🚀, 会话存储👍, " * 5,
    "russian": "аренда серверов, дешёвый хостинг, лучший чат бот, купить токены, " * 5,
    "greek": "φθηνή φιλοξενία, καλύτερο ρομπότ, αγορά κουπονιών, " * 5,
    "arabic": "استضافة رخيصة | روبوت محادثة | شراء رموز | " * 6,
    "korean": "서버 임대, 저렴한 호스팅, 최고의 챗봇, 토큰 구매, " * 5,
}
SHARE_ORDINARY = {
    "special tokens": "<|startoftext|> <s> </s> <unk>", "title": "Session store", "two words": "alpha, beta",
    "russian": "Если сервер занят, он ждёт, и это нормально, но мы не знаем, когда он ответит на запрос. " * 4,
    "korean": "서버가 다시 시작되면 게이트웨이가 세션을 복원합니다. 대기열이 비면 작업자가 결과를 전달합니다. " * 4,
    "emoji": "👩‍💻 🧪 ✅ 🐢 🚀 ✅ 🚀 🧪 ✅ ✅ 🐢 ⚠️ 🧪 🧪", "accents": "".join(c + "\u0301" for c in "To fix this, stop the ledger, remove what is late, and start again"),
    "chinese clauses": "要解决这个问题,请先停止记忆索引,删除过期租约,然后重新开始。" * 2 + "\nTags: broken-child-task, shared-draft-plan\n",
    "few items": PROSE + "gpu rental\nchat bot\nproxy pool\n",
}


@pytest.mark.parametrize("name", SHARE_CASES)
def test_lists_by_share(name):
    assert spam.is_spam(spam.features(SHARE_CASES[name])), spam.features(SHARE_CASES[name])


@pytest.mark.parametrize("name", SHARE_ORDINARY)
def test_no_lists_by_share(name):
    assert not spam.is_spam(spam.features(SHARE_ORDINARY[name])), spam.features(SHARE_ORDINARY[name])


OTHER_PROSE = {
    "pl": "Wczoraj wieczorem poszedłem do kina z przyjaciółmi. Film był bardzo ciekawy, ale trochę za długi. Po seansie wróciliśmy do domu pieszo, rozmawiając o fabule. Jutro mamy spotkanie w pracy, więc muszę wstać wcześnie.",
    "it": "Ieri sera siamo andati al cinema con gli amici. Il film era molto interessante, ma troppo lungo. Dopo lo spettacolo siamo tornati a casa a piedi, parlando della trama. Domani ho una riunione di lavoro.",
    "pt": "Ontem à noite fomos ao cinema com os amigos. O filme era muito interessante, mas demasiado longo. Depois voltámos para casa a pé, conversando sobre a história. Amanhã tenho uma reunião de trabalho.",
    "et": "Eile õhtul läksime sõpradega kinno. Film oli väga huvitav, aga liiga pikk. Pärast seanssi kõndisime koju ja rääkisime loost. Homme on mul tööl koosolek.",
}


@pytest.mark.parametrize("language", sorted(OTHER_PROSE))
def test_prose_of_languages_without_a_list(language):
    assert not spam.is_spam(spam.features(OTHER_PROSE[language]))


def test_short_stuffed_page():
    assert spam.is_spam(spam.features("cheap shoes, buy shoes, shoes online, discount shoes, sale shoes"))


def test_thresholds_come_from_the_pages(spark):
    """A language whose ordinary pages repeat their words has a higher threshold than one whose pages don't."""
    words = [a + b + "er" for a in ("gat", "led", "win", "chan", "plan", "mon", "pay", "sess", "adap", "arch") for b in ("ab", "ec", "id", "of", "ug", "am", "en", "ir", "os", "ut")]
    page = lambda n, m: " ".join([f"The {words[(n + k) % 100]} of the {words[(n * 7 + k * 3 + 50) % 100]} is at the {'anchor' if k < m else words[(n * 3 + k + 25) % 100]}." for k in range(30)])
    rows = [(i, page(i, 4)) for i in range(400)] + [(1_000 + i, None) for i in range(3)]
    often = [(i, page(i, 30)) for i in range(400)]
    low, high = (spam.calibrated(spam.analysed(spark.createDataFrame(r, "doc_id long, text string"))).filter("language = 'en'").first() for r in (rows, often))
    assert low.top_word < high.top_word and low.top_word >= spam.FLOORS["top_word"]
    found = {r.doc_id: r.is_spam for r in spam.page_features(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(found) == 403 and not any(found[i] for i in range(1_000, 1_003))
