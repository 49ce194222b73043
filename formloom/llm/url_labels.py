"""A small labelled URL table, for filters that are given none of their own.

Words of unwanted and of ordinary sites, and invented names of ordinary ones,
are set into a few shapes of hosts and paths; top-level domains, languages,
numbers and endings go round alike in both classes, so they tell nothing.
"""

from __future__ import annotations

from itertools import product

#: Words of unwanted sites (gambling, drugs, adult, advertising and tracking, spam, theft, dubious money).
BLOCK = """casino poker bets betting slots jackpot lottery roulette gamble bingo pills viagra cialis pharma-deal steroids adult porn
xxx sexcam escort nude milf ads adserver adclick banner-ads popunder tracker track clicktrack spam linkfarm spam-farm backlinks
doorway phishing malware warez keygen crack payday quick-loans free-money get-rich replica-watches miracle-diet prize-win""".split()
#: Words that such sites put beside them.
BESIDE = ["cheap", "free", "win", "best", "hot", "x", "online", "now", "24", "bonus"]
#: Words of ordinary sites, some of them beginning or ending like the above.
ALLOW = """news museum library school university garden recipes kitchen travel weather science history music books health hospital
city council forum wiki docs developer software photo football theatre cinema market bakery bank insurance energy nature forest
river farmers winter windows freedom adventure address advice alphabet better badminton spanish sports gazette tribune herald
journal magazine academy institute research gallery archive railway airport harbour church charity parish weekly trackside cheapside thing
reading morning building clothing spring nation station action table cable stable pillow hotel hospitality adapter fabric""".split()
#: Syllables of invented names.
_SYLLABLES = "an ber con del en fra gul hor in jor kal lem mon nor ost per qui ran sil ter th tion un ver wal yor zen".split()
_HOSTS = ["{a}.{t}", "www.{a}.{t}", "{b}-{a}.{t}", "{a}-{b}.{t}", "m.{a}.example.{t}", "blog.{b}{a}.{t}", "{a}{b}.example.{t}", "www.{a}-{b}.example.{t}"]
_TOP, _LANGUAGES, _ENDINGS = ["com", "net", "org"], ["en", "de", "fr", "es"], ["", "/", ".html"]


def labelled_urls() -> list[tuple[str, int]]:
    """(url, block) rows: some 380 unwanted and some 1,400 ordinary ones."""
    made = ["".join(x) for x in product(_SYLLABLES[::2], _SYLLABLES[1::2])]
    groups = [(BLOCK, BESIDE, 1), (ALLOW, ["the", "my", "daily", "new", "old", "north", "city", "24", "online", "best"], 0), (made, ["the", "my", "news", "24"], 0)]
    out = []
    for words, beside, block in groups:
        for k, (word, shape) in enumerate(product(words, _HOSTS)):
            if words is made and k % 2:
                continue
            host = shape.format(a=word, b=beside[k % len(beside)], t=_TOP[(k + k // 8) % 3])
            out.append((f"http://{host}/{_LANGUAGES[(k + k // 7) % 4]}/{k * 37 % 9973}{_ENDINGS[(k + k // 5) % 3]}", block))
    return out
