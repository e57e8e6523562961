"""URL filter on hosts it has not seen, and against a plain twin."""

import re
import zlib

import numpy as np
import pytest

from auditlake.llm import url_filter
from auditlake.llm.common import table

#: Hosts outside the labelled table, with paths without meaning: to be blocked, and not.
BLOCK = (
    "online-gambling.com pharmacy-discount.net roulette.org hot-girls.com pokerstars-bonus.com xxxvideos.org megacasino.com freeporn-tube.net sexchat.com "
    "cheapviagra-shop.net bestbets365.com jackpotcity.com slotsofvegas.com bingo-hall.net adulttoys-cams.com popupads.net click-tracker.io spammails.org "
    "torrentz.eu warezbb.org keygens.net crackedgames.com paydayloan-fast.com replicawatches.cn buyseolinks.com escorts-city.com lotterywinner.info "
    "casinoroyale.com buy-pills-online.net pornhubs.com gamblinghall.com freebingo.net viagra4u.com cheapxanax.org erotikshop.de camshow.tv adsrv.biz "
    "popunder-network.com backlinkshop.com payday24.com fakeids.ph torrentking.org casinobonus.net lotteryresults-win.com hentaiworld.com"
).split()
ALLOW = (
    "free-books.org online-library.net cheap-flights-guide.com best-recipes.com daily-weather.org nature-photos.net history-museum.org childrens-stories.com "
    "cityhospital.org mathsforum.net linuxhelp.org readingclub.net essexcouncil.gov.uk chess-puzzles.com gardening-world.com pythonworld.org newtheatre.com "
    "wildflowers.org hotelguide.net football-news.com castletours.com sussex-university.ac.uk winery-tours.com bettercoffee.com poetryjournal.org "
    "railwaymaps.net dentalclinic.com volunteerfire.org bakerystreet.com addressbook.org mountainbikes.org physicsclass.net cafemusic.com gardenersworld.com "
    "kidsmuseum.org oldmaps.net climatedata.org novelreaders.com birdwatchers.info townlibrary.org chesstrainer.com surgeryunit.org frenchgrammar.net "
    "jazzradio.com harbourpilots.org"
).split()
BAD_PATHS = "/casino-win/xxx-porn /games/poker-room /best/casino/12 /offers/viagra.html /sex/videos /cams/live /betting-odds/1 /torrents/new /payday-loans /online-gambling/".split()
GOOD_PATHS = "/books/12 /reading-list/ /flights/rome.html /recipes/soup /weather/today /photos/birds /tours/castle /stories/12 /doctors/team /algebra/rings".split()


@pytest.fixture(scope="module")
def judged(spark):
    urls = [(f"https://www.{h}/en/12", y) for y, hosts in ((1, BLOCK), (0, ALLOW)) for h in hosts]
    urls += [(f"https://{h}{p}", y) for y, paths in ((1, BAD_PATHS), (0, GOOD_PATHS)) for h, p in zip(ALLOW, paths)]
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id long, url string")
    rows = {r.page_id: r for r in url_filter.judge(df).collect()}
    return [(u, y, rows[i]) for i, (u, y) in enumerate(urls)]


def test_hosts_and_paths_outside_the_table(judged):
    seen = {part for u, _ in url_filter.labelled_urls() for part in [url_filter.split_url(u)[0], *url_filter.split_url(u)[0].split(".")]}
    hosts = [h for h in BLOCK + ALLOW if h in seen or h.split(".")[0] in seen]
    judged = [(u, y, r) for u, y, r in judged if not any(h in u for h in hosts)]
    said = [(y, r.score >= 0.5) for _, y, r in judged]
    hit, blocked, bad = sum(y and b for y, b in said), sum(b for _, b in said), sum(y for y, _ in said)
    assert len(said) > 80 and hit / blocked >= 0.9 and hit / bad >= 0.9


def test_no_host_of_the_pages_is_in_the_table(spark):
    ours = {part for u, _ in url_filter.labelled_urls() for part in url_filter.split_url(u)[0].split(".")}
    pages = {part for r in table(spark, "/root/testdata/sf0.1", "pages").select("url").collect() if r.url for part in url_filter.split_url(r.url)[0].split(".")}
    assert ours & pages <= {"www", "m", "blog", "example", "com", "org", "net"}


def test_host_path_rule_and_score_equal_a_plain_twin(spark):
    weights, bias = url_filter.train(url_filter.labelled_urls())
    urls = ["https://A.b.NET/x?y=1#z", "http://example.net/en/1", "http://www.example.com/de/2", "ftp://k.org/fr/", "x.org/fr/", "://", None, "", "http://É.org?q", "http://h#/a",
            "http://a.org/fr/b://c/d", "http://notexample.net.org/fr", "http://" + "l" * 20_000 + "/" + "p" * 20_000, "http://same.org/x", "http://same.org/x"]
    got = url_filter.judge(spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, score string")).collect()
    assert len(got) == len(urls)
    for r in got:
        match = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", urls[r.page_id] or "")
        host, path = (match.group(1), match.group(2)) if match else ("", "")
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, None)
        codes = {zlib.crc32(f"{t}{s[i:i + n]}".encode()) >> (32 - url_filter.BITS) for t, s in (("h", f"^{host}$"), ("p", f"^{path}$")) for n in url_filter.ORDERS for i in range(len(s) - n + 1)}
        score = 1 / (1 + np.exp(-np.clip(bias + sum(weights[c] for c in codes), -35, 35)))
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.score == pytest.approx(score)
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))


def test_empty_table(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
