"""A small table of labelled urls, written by hand: what the url filter is trained on where no other table is given.

Blocked are urls as lists of unwanted sites have them: gambling, pharmacies, adult sites, advertising and tracking, loans,
fakes, pirated software, spam and link farms. Allowed are urls of ordinary sites, in several languages, some with words that
only look alike. Domains, languages and paths of articles are on both sides.
"""

# The labelled urls.
BLOCKED = """
http://royal-casino-online.com/en/bonus
https://www.luckycasinoroom.net/en/5512
http://casino-nacht.de/de/spiele.html
http://pokerjackpot24.org/en/202/
https://poker-chips-pro.org/fr/88
http://www.slotsparadise.net/es/1007.html
https://megaslots777.com/spin
http://roulette-gratis.org/es/314/
https://m.bet-odds-king.org/en/4410
http://sportbets365pro.net/en/77.html
https://www.betting-tipster.org/en/19?ref=aff
http://wetten-bonus.com/de/2031
https://m.bingo-winner.net/en/6
http://jackpotwin-now.org/en/7781/
https://lottery-win-prize.org/en/claim
http://cheappillsonline.com/en/1120
https://pills-without-rx.net/en/555.html
http://viagra-generic-shop.org/fr/23
https://www.cialis-rabatt.org/de/910
http://discount-pharmacy-rx.com/en/4/
https://canadian-pharma-meds.net/en/order
http://weightloss-pills-fast.org/en/7070
https://xxx-videos-free.com/en/1
http://www.adultcams-live.net/en/room9
https://hot-xxx-girls.org/es/443.html
http://pornotube-hd.org/fr/12/
https://escort-city-night.com/de/87
http://m.adult-dating-tonight.net/en/999
https://sexchat-free.org/en/55?ref=x
http://nude-webcams.org/en/cam
https://ads.bannerserve.com/click?id=7
http://adserver-pop.net/serve/1182
https://www.adtrackpixel.org/t/88.html
http://track-clicks.net/r/4521
https://clicktracker-stats.org/en/64
http://popup-ads-media.com/en/pop
https://banner-exchange.net/de/3345
http://tracking-pixel-cdn.org/p/1.gif
https://affiliate-clicks.org/en/81?utm_source=feed
http://push-ads-network.net/en/230/
https://retarget-track.com/fr/9
http://payday-loans-now.org/en/apply
https://quickloan-nocredit.net/en/32.html
http://kredit-sofort-ohne.org/de/456
https://www.fastcash-loan.com/en/2
http://credit-repair-trick.net/es/677
https://bitcoin-doubler.org/en/invest
http://crypto-profit-robot.org/en/5019
https://forex-secret-win.net/fr/10/
http://blog.get-rich-quick.org/en/41
https://replica-watches-sale.com/en/rolex
http://fake-handbags-outlet.net/en/88.html
https://www.replicashoes.org/en/602
http://cheap-sunglasses-outlet.org/fr/7
https://keygen-crack-serial.net/en/dl
http://crackedgames.org/en/1203
https://warez-torrents-full.com/en/3
http://free-movie-torrent.net/es/991/
https://www.serialz-keygen.org/de/14
http://hacked-apk-mods.org/en/78
https://spam-links-directory.com/en/1
http://linkfarm-seo.net/en/4444
https://www.buy-backlinks.org/en/order
http://blog.seo-spamblast.org/de/52.html
https://bulk-email-spammer.net/en/6
http://free-giftcards-winner.com/en/claim
https://free-iphone-prize.net/en/301
http://www.surveys-for-cash.org/en/9/
https://m.freebies-free-stuff.org/en/12
http://miracle-detox-cure.net/fr/66
https://work-from-home-cash.org/en/5
http://download-free-codec.com/en/setup.html
https://toolbar-installer.net/en/38
http://virus-alert-fix.org/en/scan
https://login-verify-account.org/en/secure
""".split()
ALLOWED = """
https://www.cityherald.com/en/news/5512
http://morningpost.net/en/1007.html
https://lanotizia.org/it/cronaca/12
http://www.tagesanzeige.de/de/politik/314
https://lejournal.net/fr/culture/88
http://elperiodico.org/es/deportes/77.html
https://encyclopedia.org/wiki/Photosynthesis
http://en.dictionaryterms.com/wiki/term
https://docs.compilerproject.org/en/latest/
http://www.opendatabase.org/manual/12.html
https://kernelsources.net/pub/linux/
http://forum.gardeners.org/en/4410
https://www.botanicgarden.net/en/visit
http://rosegrowers.com/en/23
https://kitchenstories.org/en/recipes/612
http://www.brotbacken.de/de/rezepte/87
https://recettesdegrandmere.fr/fr/910
http://cocinafacil.es/es/443.html
https://www.museumofhistory.org/en/exhibits/6
http://naturalhistory.net/en/collections/32
https://kunsthalle.org/de/ausstellung/9
http://musee-des-arts.fr/fr/visite/12/
https://library.university.edu/catalog/5019
http://www.stadtbibliothek.org/de/suche/456
https://bibliotheque-nationale.fr/fr/1203
http://highschool.org/en/calendar/81
https://www.primaryschool.net/en/parents/3
http://collegecourses.edu/en/physics/101
https://universidad.es/es/facultad/991/
http://science-journal.org/en/articles/7070
https://www.astronomers.net/en/telescopes/64
http://chemistryworld.org/en/230/
https://arxivpapers.org/abs/1203.4444
http://mathforum.net/en/questions/55
https://weatherservice.gov/en/forecast/602
http://www.wetterdienst.de/de/karte/52.html
https://meteo-regionale.fr/fr/66
http://railwaytimes.net/en/timetable/38
https://www.busconnections.org/en/routes/5
http://fahrplan.org/de/2031
https://airportguide.com/en/arrivals/9/
http://www.cityhotel.com/en/rooms/7
https://mountainlodge.net/en/contact
http://hikingtrails.org/en/trail/1
https://www.cyclingclub.net/en/tours/78
http://sailingschool.com/en/lessons/4
https://rowing.org/en/results/2019
http://footballclub.net/en/fixtures/301
https://www.tennisverein.de/de/plan/14
http://chessleague.org/en/games/88.html
https://hospital.org/en/departments/19
http://www.childrensclinic.net/en/4/
https://dentists.org/en/advice/10/
http://apotheke-am-markt.de/de/oeffnungszeiten
https://publichealth.gov/en/vaccines/55
http://www.parliament.gov/en/bills/41
https://citycouncil.gov/en/minutes/677
http://rathaus.de/de/termine/3345
https://www.tribunal.fr/fr/decisions/7
http://farmersmarket.org/en/stalls/12
https://organicfarm.net/en/vegetables/5
http://www.beekeeping.com/en/hives/202/
https://winery.com/en/visit/6
http://vineyards.fr/fr/caves/23
https://theatre.org/en/programme/999
http://www.symphony.net/en/concerts/1
https://jazzfestival.com/fr/10/
http://filmarchive.org/en/titles/1182
https://www.photographers.net/en/gallery/8
http://paintingclass.com/en/18
https://bookshop.com/en/authors/1120
http://www.publisher.net/en/series/555.html
https://poetry.org/en/poems/4521
http://storytelling.org/en/9
https://travelnotes.com/en/lisbon/2
http://www.islandferry.net/en/prices/6.html
https://campingplatz.de/de/anfahrt/87
http://villagehall.org/en/booking/41
https://www.parishchurch.net/en/services/7781/
http://charityrun.org/en/donate/5
https://volunteers.net/en/projects/32.html
http://animalshelter.com/en/dogs/64
https://www.birdwatching.org/en/sightings/9
http://aquarium.com/en/tickets/88
https://engineering.net/en/bridges/3
http://www.carpenters.org/en/tools/2
https://electricians.com/en/wiring/14
http://knitting.org/en/patterns/910
https://www.sewingcircle.net/en/quilts/1007
http://modelrailways.com/en/tracks/50
https://trackandfield.org/en/athletes/17
http://adirondackparks.net/en/maps/4410
https://www.betterlanguages.org/en/lessons/19
http://essexhistory.net/en/towns/312
https://blog.softwarecraft.net/en/2021/tests
http://programming.org/en/tutorials/455
https://www.typography.com/en/fonts/27
http://m.newsletter.net/en/archive/120
https://m.dailyreader.com/fr/7424.html
http://blog.mathteacher.org/en/482/
https://blog.slowfood.net/es/8924?utm_source=feed
http://winterharbour.com/en/5462#top
https://freelandmuseum.org/en/1552?page=2&ref=x
http://thornton.net/en/1776.html
https://www.atherton.org/de/8511
http://hereford.com/en/6481?utm_source=feed
https://strathern.net/es/4918#top
http://m.ethington.org/en/1570
https://whitehaven.com/fr/9689/
http://linden.org/en/233.html
https://ostend.net/de/343
""".split()
