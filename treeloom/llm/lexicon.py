"""Seed lexicons of the subject labelling functions.

The words are the everyday vocabulary of each field, written down from general knowledge as a dictionary or an encyclopedia's
index would list it, without regard to any collection the operator is run on. They only start the learning: what else
speaks for a subject is counted from the documents.
"""

from __future__ import annotations

#: Fixed word lists: names of things, people and acts of a field. A word of two fields stands under both and needs company in each.
TERMS = {
    "agriculture": "agriculture, farm, farmer, farming, farmland, crop, harvest, livestock, cattle, cow, sheep, goat, pig, poultry, hen, herd, flock, barn, stable, pasture, meadow, hay, straw, grain, wheat, barley, oat, rye, maize, rice paddy, soybean, potato field, orchard, vineyard, greenhouse, seed, seedling, sowing, soil, manure, compost, fertilizer, fertiliser, pesticide, herbicide, weed, irrigation, plough, plow, tractor, combine harvester, silo, dairy, milking, shepherd, rancher, ranch, beekeeper, beehive, agronomist, hectare, acre, drought, horticulture, gardener, pruning, fodder, lamb, calf, veterinary",
    "education": "education, school, teacher, pupil, student, classroom, lesson, homework, exam, examination, grade, curriculum, syllabus, textbook, blackboard, headteacher, principal, kindergarten, nursery school, primary school, secondary school, high school, college, university, campus, faculty, professor, lecturer, lecture, seminar, tutor, tutorial, semester, term paper, thesis, dissertation, diploma, degree, graduate, graduation, undergraduate, scholarship, tuition, enrolment, enrollment, coursework, essay, quiz, spelling, arithmetic, literacy, pedagogy, apprentice, apprenticeship, report card, school year, schoolchildren, detention, dormitory, alumni",
    "energy": "energy, electricity, electric power, power plant, power station, power grid, power line, grid, generator, turbine, wind turbine, wind farm, solar panel, solar power, photovoltaic, hydroelectric, hydropower, dam, reservoir, reactor, nuclear power, uranium, coal, coal mine, oil, petroleum, natural gas, gas pipeline, pipeline, refinery, fuel, fuel cell, hydrogen, biomass, biogas, geothermal, battery, battery storage, accumulator, charging station, voltage, volt, watt, kilowatt, megawatt, gigawatt, kilowatt hour, ampere, transformer, substation, transmission line, pylon, blackout, power outage, outage, smart meter, electricity meter, heat pump, boiler, district heating, peak load, utility, emission, renewable, feed-in",
    "finance": "finance, bank, banker, banking, money, currency, exchange rate, cash, coin, banknote, loan, credit, creditor, debt, debtor, mortgage, interest rate, interest, savings, deposit, account balance, investor, investment, fund, hedge fund, pension, pension fund, stock, stock exchange, stock market, share, shareholder, bond, dividend, portfolio, broker, equity, asset, liability, balance sheet, ledger, bookkeeping, accountant, accounting, auditor, audit, budget, invoice, tax, tax return, treasury, inflation, deflation, profit, revenue, turnover, insurance, insurance premium, premium, derivative, futures, yield, cash flow, credit card, credit score, bankruptcy, insolvency, fiscal year",
    "food": "food, cook, cooking, cuisine, kitchen, recipe, ingredient, dish, meal, breakfast, lunch, dinner, supper, dessert, cake, pastry, pie, bread, dough, flour, yeast, sourdough, baker, bakery, oven, stove, frying pan, saucepan, butter, cheese, cream, egg, sugar, salt, pepper, spice, herb, garlic, onion, tomato, olive oil, vinegar, sauce, soup, broth, stew, salad, roast, grill, steak, sausage, noodle, pasta, chef, waiter, waitress, restaurant, menu, cafe, caterer, catering, tasting, flavour, flavor, seasoning, marinade, appetizer, chocolate, vegetarian, nutrition",
    "law": "law, lawyer, attorney, solicitor, barrister, judge, court, courtroom, tribunal, jury, juror, trial, lawsuit, litigation, litigant, plaintiff, claimant, defendant, prosecutor, prosecution, verdict, sentence, conviction, acquittal, appeal, appellate, supreme court, evidence, testimony, witness, oath, affidavit, subpoena, injunction, statute, legislation, act of parliament, regulation, constitution, jurisdiction, contract, clause, breach of contract, tort, damages, liability, negligence, settlement, arbitration, mediation, notary, testament, inheritance, copyright, patent, trademark, tenancy, landlord, lease, custody, bail, crime, legal",
    "medicine": "medicine, medical, doctor, physician, surgeon, nurse, midwife, paramedic, hospital, clinic, ward, patient, outpatient, emergency room, intensive care, surgery, operation, anaesthetic, anesthetic, diagnosis, symptom, disease, illness, infection, fever, cough, virus, bacteria, inflammation, fracture, wound, injury, pain, allergy, asthma, diabetes, insulin, cancer, tumour, tumor, chemotherapy, stroke, heart attack, blood pressure, blood test, x-ray, radiology, vaccine, vaccination, antibiotic, drug, dose, dosage, tablet, pill, prescription, pharmacy, pharmacist, therapy, physiotherapy, rehabilitation, treatment, clinical trial, health care, epidemic, pediatrics, cardiology, oncology, dentist",
    "music": "music, musician, musical, song, singer, songwriter, lyrics, melody, harmony, rhythm, tempo, chord, note, scale, key signature, treble clef, sheet music, score, composer, composition, conductor, orchestra, symphony, concerto, sonata, opera, choir, chorus, soprano, alto, tenor, baritone, piano, pianist, organ, violin, violinist, viola, cello, double bass, guitar, bass guitar, drum, drummer, percussion, flute, clarinet, oboe, trumpet, trombone, saxophone, harp, synthesizer, band, quartet, concert, encore, rehearsal, recording studio, album, vinyl, playlist, microphone, amplifier, jazz",
    "science": "science, scientist, scientific, physics, physicist, chemistry, chemist, biology, biologist, astronomy, astronomer, geology, geologist, mathematics, laboratory, experiment, hypothesis, theory, observation, measurement, microscope, telescope, spectrometer, spectrum, wavelength, particle, particle accelerator, atom, electron, proton, neutron, photon, quantum, molecule, compound, chemical reaction, catalyst, enzyme, protein, cell, gene, genome, mutation, evolution, species, organism, bacterium, fossil, sediment, galaxy, star, planet, orbit, comet, gravity, isotope, radiation, thermodynamics, climate model, researcher, research, peer review, field study",
    "software": "software, program, programmer, programming, developer, source code, codebase, compiler, interpreter, debugger, debugging, bug, bug fix, unit test, integration test, test suite, regression, refactoring, code review, pull request, merge request, merge conflict, commit, branch, repository, version control, release, deployment, rollback, continuous integration, build pipeline, container, virtual machine, server, backend, frontend, database, database migration, query planner, cache, memory leak, stack trace, race condition, deadlock, thread, garbage collector, operating system, kernel, library, framework, package manager, dependency, microservice, endpoint, load balancer, feature flag, linter, type checker, runtime, algorithm, open source",
    "sport": "sport, athlete, athletics, team, player, coach, trainer, referee, umpire, match, game, tournament, championship, league, cup final, final, season, goal, goalkeeper, striker, midfielder, defender, penalty, penalty kick, offside, football, footballer, soccer, basketball, volleyball, handball, hockey, tennis, cricket, rugby, baseball, golf, boxing, wrestling, gymnastics, gymnast, swimming, swimmer, rowing, sailing, cycling, cyclist, skiing, marathon, sprint, sprinter, hurdle, relay, long jump, high jump, stadium, pitch, court, track, lap, medal, trophy, podium, world record, olympic, olympics, half-time, scoreboard, fan, transfer window, training camp",
    "travel": "travel, traveller, traveler, journey, trip, tour, tourist, tourism, tour guide, guidebook, holiday, vacation, sightseeing, excursion, itinerary, destination, airport, airline, flight, boarding pass, gate, departure, arrival, layover, luggage, suitcase, backpack, passport, visa, customs, border, border crossing, ticket, train, train station, railway, bus, coach, ferry, cruise, harbour, harbor, port, rental car, car rental, road trip, motorway, map, hotel, hostel, inn, guest house, bed and breakfast, campsite, tent, resort, beach, island, museum, castle, souvenir, reservation, booking, check-in, reception, hiking, hiking trail, timetable",
}
#: Fixed list of common turns of speech that use a field's words for something else; they are taken out before anything is counted.
FIGURES = (
    r"not rocket science", r"rocket science", r"down to a science", r"an exact science", r"the acid test", r"litmus test", r"a quantum leap", r"level playing field", r"move the goalposts", r"drop(ped|s)? the ball", r"whole new ball ?game", r"ball is in \w+ court", r"hit it out of the park",
    r"touch(es|ed)? base", r"on the home straight", r"jump(ed|s)? the gun", r"it('s| is| was) a marathon", r"a marathon,? not a sprint", r"second fiddle", r"fac(e|es|ed|ing) the music", r"str(ikes?|uck) an? (\w+ )?chord", r"(hit|strike|struck) the right note", r"change of tempo", r"music to \w+ ears", r"sings? (from )?the same",
    r"bread and butter", r"food for thought", r"icing on the cake", r"piece of cake", r"(with )?a (pinch|grain) of salt", r"recipe for (disaster|success|trouble)", r"spill the beans", r"bring home the bacon", r"half-baked", r"low-hanging fruit", r"reap what", r"sow the seeds of", r"bumper harvest of", r"make hay", r"needle in a haystack", r"beat around the bush",
    r"the jury is (still )?out", r"laid? down the law", r"unwritten law", r"judge a book", r"day in court", r"open and shut case", r"clean bill of health", r"just what the doctor ordered", r"a bitter pill", r"take the pulse", r"a shot in the arm", r"a taste of \w+ own medicine", r"school of thought", r"learn(ed|t)? (a|\w+) lesson", r"textbook example", r"old school", r"by the book",
    r"break the bank", r"bank(ed|s)? on", r"pays? dividends", r"money down the drain", r"invest(ed)? (time|effort) in", r"in the black", r"full steam ahead", r"run out of steam", r"power play", r"off the grid", r"a long journey", r"off the beaten track", r"in the same boat", r"jump on the bandwagon", r"hit the road", r"a bumpy ride",
)
#: Fixed: most frequent function words of other languages, and the same fields' everyday words, counted only in sentences of the language.
OTHER = {
    "fr": ("le la les l des du de d un une et est en dans que qui pour par sur avec ne pas ce se au aux", {
        "agriculture": "agriculture agriculteur ferme récolte moisson champ blé bétail vache mouton troupeau tracteur engrais verger vigne semence élevage sol",
        "education": "école élève étudiant professeur enseignant enseignement classe cours leçon examen université lycée collège diplôme devoir devoirs",
        "energy": "énergie électricité courant centrale réacteur éolienne barrage panneau solaire batterie réseau tension charbon pétrole turbine",
        "finance": "finance banque argent crédit prêt dette intérêt action bourse dividende épargne impôt bilan facture hypothèque investisseur",
        "food": "cuisine cuisinier recette repas plat dessert gâteau pain pâte farine four beurre fromage sauce soupe restaurant épice",
        "law": "loi droit juge tribunal avocat procès jugement contrat plainte témoin preuve accusé clause notaire justice",
        "medicine": "médecine médecin hôpital infirmière patient maladie traitement chirurgie diagnostic vaccin ordonnance symptôme fièvre pharmacie",
        "music": "musique musicien chanson chanteur mélodie rythme orchestre chœur concert piano violon guitare accord partition opéra",
        "science": "science scientifique physique chimie biologie laboratoire expérience hypothèse molécule atome espèce télescope chercheur recherche",
        "software": "logiciel programme programmeur programmation développeur code compilateur serveur débogage version déploiement dépôt",
        "sport": "sport équipe joueur entraîneur arbitre match tournoi championnat but gardien stade course médaille athlète",
        "travel": "voyage voyageur touriste tourisme hôtel auberge avion vol aéroport gare train billet bagage valise passeport plage excursion",
    }),
    "es": ("el la los las de del un una y es en que para por con no se su al lo como más", {
        "agriculture": "agricultura agricultor granja cosecha cultivo campo trigo ganado vaca oveja rebaño tractor abono huerto viñedo semilla riego suelo",
        "education": "escuela alumno estudiante profesor maestro maestra enseñanza clase lección examen universidad instituto colegio diploma deberes",
        "energy": "energía electricidad corriente central reactor aerogenerador presa panel solar batería red tensión voltaje carbón petróleo turbina",
        "finance": "finanzas banco dinero crédito préstamo deuda interés acción bolsa dividendo ahorro impuesto balance factura hipoteca inversor",
        "food": "cocina cocinero receta comida plato postre pastel pan masa harina horno mantequilla queso salsa sopa restaurante especia",
        "law": "ley derecho juez tribunal abogado juicio sentencia contrato demanda testigo prueba acusado cláusula notario justicia",
        "medicine": "medicina médico hospital enfermera paciente enfermedad tratamiento cirugía diagnóstico vacuna receta síntoma fiebre farmacia",
        "music": "música músico canción cantante melodía ritmo orquesta coro concierto piano violín guitarra acorde partitura ópera",
        "science": "ciencia científico física química biología laboratorio experimento hipótesis molécula átomo especie telescopio investigador investigación",
        "software": "software programa programador programación desarrollador código compilador servidor depuración versión despliegue repositorio",
        "sport": "deporte equipo jugador entrenador árbitro partido torneo campeonato gol portero estadio carrera medalla atleta",
        "travel": "viaje viajero turista turismo hotel hostal avión vuelo aeropuerto estación tren billete equipaje maleta pasaporte playa excursión",
    }),
    "de": ("der die das den dem des ein eine einen einer und ist in im zu mit von auf für nicht sich auch als wird", {
        "agriculture": "landwirtschaft landwirt bauer bauernhof ernte acker feld weizen vieh kuh schaf herde traktor dünger obstgarten weinberg saatgut bewässerung",
        "education": "schule schüler schülerin student lehrer lehrerin unterricht klasse lektion prüfung universität hochschule gymnasium zeugnis hausaufgabe vorlesung",
        "energy": "energie strom elektrizität kraftwerk reaktor windrad windkraft staudamm solaranlage batterie stromnetz spannung kohle erdöl turbine umspannwerk",
        "finance": "bank geld kredit darlehen schulden zins zinsen aktie börse dividende sparen steuer bilanz rechnung hypothek anleger konto",
        "food": "küche koch rezept mahlzeit gericht nachtisch kuchen brot teig mehl ofen butter käse soße suppe restaurant gewürz",
        "law": "gesetz recht richter richterin gericht anwalt anwältin prozess urteil vertrag klage zeuge beweis angeklagter klausel notar justiz",
        "medicine": "medizin arzt ärztin krankenhaus klinik krankenschwester patient patientin krankheit behandlung chirurgie diagnose impfstoff impfung rezept symptom fieber apotheke",
        "music": "musik musiker lied sänger sängerin melodie rhythmus orchester chor konzert klavier geige gitarre akkord partitur oper",
        "science": "wissenschaft wissenschaftler physik chemie biologie labor experiment versuch hypothese molekül atom teleskop forscher forschung messung",
        "software": "software programm programmierer programmierung entwickler quelltext compiler server fehlersuche version bereitstellung repository",
        "sport": "sport mannschaft spieler trainer schiedsrichter spiel turnier meisterschaft tor torwart stadion rennen medaille athlet",
        "travel": "reise reisender tourist tourismus hotel herberge flugzeug flug flughafen bahnhof zug fahrkarte gepäck koffer reisepass strand ausflug",
    }),
}


def terms() -> dict[str, tuple[str, ...]]:
    """phrase in lower case -> subjects."""
    out: dict[str, tuple[str, ...]] = {}
    for s, all_ in TERMS.items():
        for t in all_.split(","):
            out[t.strip().lower()] = (*out.get(t.strip().lower(), ()), s)
    return out
