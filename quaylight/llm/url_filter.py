"""URL filters: host and path rules first, then a logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylight.llm.words import buffers

#: Orders of the n-grams, in bytes; cells of the hash table, half for hosts and half for paths.
ORDERS, CELLS = (3, 4, 5), 1 << 14
#: Strength of the ridge penalty, steps of gradient descent and their rate.
RIDGE, STEPS, RATE = 1e-4, 1000, 12.0
#: Part of URLs that are taken to be blocked ones, whatever their part of the table.
BLOCKED_SHARE = 0.35
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: The small labelled table: URLs to block and to allow, with paths in four languages.  Some allowed ones speak of what
#: blocked ones sell, and some blocked ones look like shops, news or schools.
BLOCKED = """
www.casino-royal-spins.com/en/slots/welcome-bonus  play-casinos-online.net/jackpot?ref=12  pokerstakes24.com/en/freerolls  de.spielautomaten-kasino.com/bonus/freispiele  fr.casino-enligne-gratuit.com/machines-a-sous
tragaperras-gratis.es/casino/giros-gratis  bet-winner365.com/live/betting-odds  sportwetten-tipps24.de/quoten/bonus  parissportifs-cotes.fr/bonus-pari  apuestas-deportivas-hoy.com/bono-bienvenida
lottowin-daily.biz/claim-prize  luckyspin.club/win/free-money  slotmachine777.xyz/spin  mega-jackpots.top/en/play-now  roulette-blackjack.live/table/7
hotxxxvideos.net/watch/8812  freeporntube.xxx/category/amateur  sexcams-live.com/en/chat/adult  nackte-girls-cam.de/livecams  videos-porno-gratuit.fr/amateur/sexe
porno-gratis-xxx.com/videos/maduras  adultdating-tonight.com/hookup/nearby  escort-city-girls.com/madrid/independent  nude-pics-daily.net/gallery/44  erotikchat24.de/livesex
cheap-viagra-pills.com/order-now?no-prescription=1  buycialisonline.net/generic/tadalafil  potenzmittel-rezeptfrei.de/bestellen  pharmacie-sansordonnance.com/viagra-pas-cher  pastillas-sin-receta.com/comprar-viagra
diet-pills-miracle.com/lose-weight-fast  weightloss-keto-gummies.shop/buy  steroids4sale.biz/anabolic/order  cheapmeds-rx.top/xanax-no-prescription  male-enhancement-pro.net/enlarge
crackedsoftware-download.net/keygen/office  warez-zone.to/full-crack/photoshop  serialkeys-free.info/activator/windows  torrentz-movies.cc/download/1080p-rip  filme-stream-kostenlos.to/torrent
telecharger-crack-gratuit.com/logiciel/keygen  descargar-crack-full.net/serial/activador  apk-mod-unlimited.com/hack/coins  freegames-hack.club/cheats/generator  nulledscripts.cc/themes/download
get-rich-quick-crypto.com/earn/daily-profit  bitcoin-doubler.biz/invest/1000x  forex-signals-guaranteed.net/profit  make-money-fast-home.com/secret-method  geld-verdienen-schnell.de/krypto-trick
gagner-argent-facile.com/methode-secrete  ganar-dinero-rapido.com/desde-casa  payday-loans-instant.com/apply/no-credit-check  kredit-ohne-schufa24.de/sofort  prestamos-rapidos-ya.com/sin-aval
replica-watches-luxury.com/rolex/cheap  fakeid-maker.cc/order/passport  louisvuitton-outlet-cheap.shop/bags/sale90  cheapjerseys-wholesale.top/nfl  essay-writers-cheap.com/buy-essay/order
click-here-prize.info/survey/winner  youwontbelieve-this.buzz/shocking-trick  doctors-hate-her.click/one-weird-trick  free-iphone-giveaway.win/claim  verify-account-login.top/secure/paypal-update
hot-singles-area.com/meet/tonight  clickbait-celebs.buzz/shocking/photos-17  viral-shock.club/you-wont-believe/9  seo-backlinks-cheap.biz/buy-links  instant-followers.shop/buy/likes
"""
ALLOWED = """
www.city-library.org/en/opening-hours  library.state-university.edu/catalogue/search?q=poetry  stadtbibliothek.musterstadt.de/ausleihe/formulare  bibliotheque.ville.fr/horaires/enfants  biblioteca.ayuntamiento.es/catalogo/libros
museum-of-history.org/exhibitions/roman-glass  naturkundemuseum.de/ausstellung/dinosaurier  musee-beaux-arts.fr/collections/peinture  museo-nacional.es/visita/entradas  www.science-daily-notes.org/physics/article-2231
news.regional-post.com/2021/05/council-budget  nachrichten.zeitung.de/politik/bundestag-debatte  journal.lemidi.fr/culture/cinema/critique  noticias.diario.es/deportes/futbol/resultado  weather.coast-service.gov/forecast/tides
wetterdienst.de/vorhersage/morgen  meteo.fr/previsions/semaine  tiempo.es/prevision/manana  docs.python-packages.org/tutorial/install  developer.webdocs.org/reference/javascript/array
wiki.linuxusers.de/dokumentation/paketverwaltung  forum.gardeners.org/thread/tomatoes-88  rezepte.kochen.de/suppe/kartoffelsuppe  recettes-cuisine.fr/dessert/tarte-aux-pommes  recetas-cocina.es/sopa/gazpacho
travel.guidebook.com/europe/lisbon/walking-tour  reisen.berge.de/wandern/alpen  voyage-bretagne.fr/randonnee/cote  viajes-andalucia.es/rutas/sierra  maps.openroads.org/route/cycling
school-district12.k12.us/calendar/holidays  grundschule-am-park.de/termine/elternabend  ecole-primaire.fr/cantine/menu  colegio-sanjose.es/horario/clases  mathematics.lectures.edu/algebra/groups/notes
music-theory-lessons.com/harmony/chords  orchester.de/konzerte/programm  conservatoire.fr/auditions/piano  escuela-musica.es/cursos/guitarra  arxiv-mirror.org/abs/2101.00001
health-service.gov/vaccination/appointments  krankenhaus.de/abteilung/innere-medizin  hopital.fr/consultation/rendez-vous  hospital.es/urgencias/informacion  pharmacy-board.gov/prescription/safety
gambling-addiction-help.org/support/helpline  casino-history-museum.org/exhibits/monte-carlo  suchtberatung.de/gluecksspiel/hilfe  jeu-responsable.fr/aide/joueurs  ludopatia-ayuda.es/informacion/familias
sex-education.school-health.org/teens/faq  sexualaufklaerung.de/unterricht/material  drug-information.gov/sildenafil/side-effects  poker-probability.math-notes.edu/lecture/combinatorics  lottery-commission.gov/annual-report
software-archive.org/download/open-source/releases  torrents.linux-distribution.org/iso/release  crack-propagation.materials.edu/fatigue/paper  keygen.crypto-docs.org/manual/ssh  consumer-protection.gov/payday-loan/advice
verbraucherzentrale.de/kredit/ratgeber  bank-of-town.com/mortgage/rates  economics.university.edu/bitcoin/working-paper  watchmakers-guild.org/repair/escapement  essays.literature-review.org/montaigne/on-books
farmers-market.org/stalls/honey  baumarkt.de/garten/rasenmaeher  boulangerie-dupain.fr/pains/seigle  ferreteria.es/herramientas/taladro  bookshop-corner.com/fiction/new-releases
blog.harbourview.org/en/12  m.stonebridge.net/de/155.html  northfield.org/fr/105?page=2  www.riverside.net/es/98#top  meadowlane.org/en/176  hilltop-weavers.net/en/33.html  oakwood.org/de/8?utm_source=feed  blog.fernbrook.net/fr/41  thistle.org/es/133  westmoor.net/en/book/9
football-club.org/fixtures/season  chess-federation.org/ratings/juniors  tierheim.de/hunde/vermittlung  refuge-animaux.fr/chats/adoption  parque-natural.es/aves/observacion
"""


#: Domains that each host is given besides its own, names before it and paths that say nothing, so that none tells the labels apart.
DOMAINS = ("com", "org", "net")
PREFIXES = ("m.", "www.", "blog.")
PLAIN_PATHS = ("/en/12", "/de/155.html", "/fr/105?page=2", "/es/98#top", "/", "/index.html?id=7", "/2021/05/12", "/a/b/3")


def _forms(url: str, number: int) -> list[str]:
    """A URL of the table under several domains, with its own path and with plain ones, and once as a mobile page."""
    host, slash, path = url.partition("/")
    name, _, own = host.rpartition(".")
    domains = [*DOMAINS, own if own not in DOMAINS else "info"]
    plain_ = [PLAIN_PATHS[(number + k) % len(PLAIN_PATHS)] for k in range(len(domains))]
    forms = [f"https://{name}.{d}{slash}{path}" for d in domains] + [f"https://{name}.{d}{p}" for d, p in zip(domains, plain_, strict=True)]
    return [*forms, *(f"http://{PREFIXES[number % len(PREFIXES)]}{name}.{d}{slash}{path}" for d in DOMAINS)]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """``url, blocked``: the small table to fit on.

    Each host comes under all ``DOMAINS`` and with plain paths, whatever its label, so a domain or a path's shape alone
    says nothing.
    """
    rows = [(form, kind) for kind, urls in ((1, BLOCKED), (0, ALLOWED)) for k, url in enumerate(urls.split()) for form in _forms(url, k)]
    return spark.createDataFrame(rows, "url string, blocked int")


@dataclass(frozen=True)
class Rule:
    """``host/path``: fits the host and its subdomains where the URL's path begins with ``/path``."""

    rule: str
    verdict: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, in lower case for A to Z; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, or null; the list becomes part of the plan and should be short."""
    fits = None
    for r in sorted(rules, key=lambda r: (-len(r.rule), r.rule)):
        on = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        fits = F.when(on, r.rule) if fits is None else fits.when(on, r.rule)
    return F.lit(None).cast("string") if fits is None else fits


def _cells(texts: pa.Array, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, cell) of all n-grams of texts, each taken with a mark before and behind it."""
    offsets, data = buffers(texts)
    n = len(texts)
    # two marks more for each text: one before, one behind
    sizes = np.diff(offsets) + 2
    flat = np.full(int(sizes.sum()), 1, np.uint64)
    flat[np.arange(len(data)) + 2 * np.repeat(np.arange(n), np.diff(offsets)) + 1] = data
    of = np.repeat(np.arange(n), sizes)
    docs, cells = [], []
    for order in ORDERS:
        m = max(0, len(flat) - order + 1)
        key = np.full(m, order, np.uint64)
        for k in range(order):
            key = key * np.uint64(257) + flat[k : k + m]
        inside = of[:m] == of[order - 1 :] if m else np.zeros(0, bool)
        found = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (CELLS // 2).bit_length() + 1)).astype(np.int64)
        docs.append(of[:m][inside])
        cells.append(base + found[inside])
    return np.concatenate(docs), np.concatenate(cells)


@dataclass(frozen=True)
class UrlModel:
    weights: np.ndarray
    intercept: float

    def scores(self, hosts: pa.Array, paths: pa.Array) -> np.ndarray:
        """Probability that each URL is to be blocked."""
        total, count = np.zeros(len(hosts)), np.zeros(len(hosts))
        for texts, base in ((hosts, 0), (paths, CELLS // 2)):
            docs, cells = _cells(texts, base)
            total += np.bincount(docs, self.weights[cells], len(hosts))
            count += np.bincount(docs, minlength=len(hosts))
        return 1 / (1 + np.exp(-np.clip(total / np.sqrt(np.maximum(count, 1)) + self.intercept, -30, 30)))


def fit_urls(labelled: DataFrame, url: str = "url", label: str = "blocked") -> UrlModel:
    """Fits on a small table, which is brought to the driver whole; null URLs or labels are left out."""
    table = labelled.select(host_of(F.col(url)).alias("h"), path_of(F.col(url)).alias("p"), F.col(label).cast("int").alias("y")).filter("y is not null").orderBy("h", "p", "y").toArrow().combine_chunks()
    y = table.column("y").to_numpy().astype(float)
    x = np.zeros((len(y), CELLS), np.float32)
    for name, base in (("h", 0), ("p", CELLS // 2)):
        column = table.column(name)
        docs, cells = _cells(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, base)
        np.add.at(x, (docs, cells), 1)
    x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    # the weights stay sums of rows, so descent needs the rows' products only
    near, a, b = (x @ x.T).astype(float), np.zeros(len(y)), 0.0
    share = np.where(y == 1, BLOCKED_SHARE / max(1, (y == 1).sum()), (1 - BLOCKED_SHARE) / max(1, (y == 0).sum()))
    for _ in range(STEPS if len(y) else 0):
        gap = (1 / (1 + np.exp(-np.clip(near @ a + b, -30, 30))) - y) * share
        a -= RATE * (gap + RIDGE * a)
        b -= RATE * gap.sum()
    w = a @ x
    return UrlModel(w.astype(np.float32), float(b))


def judge_urls(pages: DataFrame, model: UrlModel, rules: Sequence[Rule], key: str = "page_id", url: str = "url", least: float = 0.5) -> DataFrame:
    """``key, host, path, rule, verdict, score`` of each row: the longest rule's verdict, else block from ``least`` on.

    A null URL and one without ``://`` have an empty host and path, fit no rule and get the model's verdict on no n-grams.
    Repeated rows are judged each on its own.
    """
    rows = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = rows.withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                scores = model.scores(part.column("host"), part.column("path"))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], names=[*part.schema.names, "score"])

    scored = rows.mapInArrow(run, f"key {kind}, host string, path string, rule string, score double")
    by_rule = F.create_map(*[F.lit(x) for r in rules for x in (r.rule, r.verdict)]) if rules else None
    model_says = F.when(F.col("score") >= least, "block").otherwise("allow")
    verdict = model_says if by_rule is None else F.coalesce(F.try_element_at(by_rule, "rule"), model_says)
    return scored.select(F.col("key").alias(key), "host", "path", "rule", verdict.alias("verdict"), "score")
