"""Curated subject terms of general use in English, German, French and Spanish.

They are words that the subjects are written about with anywhere, drawn from no corpus; what else marks a
subject in a given corpus is learned from its labelled documents.
A weight stands after a term where it isn't 1; terms of everyday speech weigh less. The pseudo-subject
``finance`` holds accounting and finance terms: it takes part in the decision but is never assigned.
"""

from __future__ import annotations

TERMS = {
    "science": """
        clinical trial; double-blind study; peer review; particle accelerator; electron microscope; gene expression;
        chemical reaction; control group; climate model; statistical significance; molecular biology; periodic table;
        gravitational wave; black hole; vaccine candidate; stem cell; laboratory 0.8; microscope; spectrometer;
        telescope; genome; isotope; neutron; enzyme; peptide; physicist; chemist; biologist; astronomy; experiment 0.6;
        hypothesis 0.7; Genomanalyse; Messreihe; Laborversuch; Teilchendetektor; Zellkultur; Katalysator; Mikroskop;
        Experiment 0.6; Forschung 0.6; catalyseur; catalizador; microscopio; experimento 0.6""",
    "law": """
        class action; patent infringement; breach of contract; court ruling; damages award; appellate court; supreme
        court; criminal charges; intellectual property; legal counsel; burden of proof; cease and desist; due process;
        restraining order; expert witness; amicus brief; injunction; subpoena; plaintiff; defendant; lawsuit; litigation
        0.8; tribunal 0.7; attorney 0.6; Schadenersatzforderung; Sammelklage; Patentverletzung; Berufungsgericht;
        Schiedsverfahren; Vergleichsvereinbarung; Klage 0.7; Gerichtsverfahren; Rechtsstreit; Kläger; Beklagte; litige
        0.7; plaignant; arbitraje; litigio; demandante""",
    "sport": """
        season ticket; football club; world cup; olympic games; head coach; penalty kick; grand slam; tennis match;
        basketball team; transfer window; national team; home run; relay race; training camp; gold medal; cup final;
        goalkeeper; stadium 0.8; athlete; championship 0.8; tournament; playoff; referee; marathon; Dauerkarte;
        Meisterschaftsbonus; Spielertransfer; Stadionpacht; Nachwuchsakademie; Trikotverkauf; Spielübertragung;
        Übertragungsrechte; Stadion 0.8; Meisterschaft; Fußball; Trainingslager; Schiedsrichter; stade 0.8; championnat
        0.8; joueur 0.8; arbitre; estadio 0.8; campeonato 0.8; jugador 0.8; árbitro""",
    "software": """
        source code; open-source; machine learning model; operating system; unit test; pull request; web browser; user
        interface; programming language; version control; bug fix; cloud computing; mobile app; software update; data
        structure; command line; software 0.8; compiler; programmer; database 0.7; Quellcode; Testumgebung; Fehlerliste;
        Programmierschnittstelle; Datenmigration; Cloudplattform; Softwareentwicklung; Datenbank 0.7; Programmierer;
        logiciel; développeur; desarrollador""",
    "energy": """
        substation; peak load; power grid; transmission grid; wind turbine; wind farm; power plant; natural gas; crude oil; nuclear reactor; oil well; solar panel;
        transmission line; heat pump; hydroelectric dam; carbon capture; coal mine; gas pipeline; renewable energy; fuel
        cell; megawatt; refinery; photovoltaic; electricity 0.7; Umspannwerk; Gasspeicher; Stromnetz; Batteriespeicher;
        Raffinerie; Windturbine; Kraftwerk; Strom 0.5; Erdgas; Solaranlage; éolienne; raffinerie; électricité 0.7;
        refinería; subestación; electricidad 0.7""",
    "agriculture": """
        crop yield; dairy herd; wheat harvest; crop rotation; animal husbandry; grain silo; combine harvester; organic
        farming; seed drill; feed lot; fish farm; rice paddy; soil erosion; olive grove; beef cattle; growing season;
        livestock; pesticide; fertilizer; orchard; wheat; soybean; irrigation; farmland; crop 0.7; cattle; tractor;
        Weizenernte; Obstplantage; Milchviehbestand; Saatgutsorte; Bodenfeuchte; Getreidesilo; Ernte 0.7; Viehzucht;
        Dünger; Traktor; Landwirtschaft; verger; récolte 0.7; engrais; tracteur; bétail; agriculture; huerto; cosecha
        0.7; fertilizante; ganado 0.8; agricultura""",
    "transport": """
        freight train; shipping lane; cargo ship; container port; bus route; air traffic; customs clearance; high-speed
        rail; public transport; toll road; truck driver; railway station; flight crew; ferry terminal; supply route;
        traffic jam; freight 0.8; cargo 0.8; locomotive; airport 0.8; railway; passenger 0.7; trucking; shipping 0.6;
        logistics 0.7; Hafenterminal; Lokomotive; Zollabfertigung; Containerschiff; Frachtkorridor; Lastwagenflotte;
        Eisenbahn; Flughafen 0.8; Spedition; Güterverkehr; dédouanement; aéroport 0.8; transporteur; locomotora;
        aeropuerto 0.8; ferrocarril; transportista""",
    "education": """
        school district; online course; degree programme; entrance exam; doctoral student; lecture hall; primary school;
        student loan; teacher training; distance learning; homework assignment; kindergarten class; report card; reading
        comprehension; vocational school; graduation ceremony; student 0.7; university 0.7; classroom; curriculum;
        textbook; tuition; pupil; teacher 0.8; Prüfungsvorbereitung; Lehrplan; Schulbuch; Stipendienfonds;
        Hochschulcampus; Studiengebühr; Schule 0.7; Universität 0.7; Lehrer 0.8; Studierende; université 0.7; élève 0.8;
        enseignant 0.8; matrícula 0.8; universidad 0.7; alumno 0.8; profesor 0.7""",
    "finance": """
        stock-based compensation; internal control testing; working capital; dividend policy; pension obligation;
        capital expenditures; hedging gains; revolving credit facility; retained earnings; prepaid expenses; interest
        expense; deferred revenue; restructuring charges; effective tax rate; inventory reserves; warranty accruals;
        operating cash flow; segment margins; foreign currency translation; amortization of intangibles; share
        repurchases; lease liabilities; accounts receivable; goodwill; Rückstellung; Kreditlinie; Umlaufvermögen;
        Leasingverbindlichkeiten; Dividende; provisions; obligations locatives; dividende; ligne de crédit; fonds de
        roulement; línea de crédito; dividendo; provisiones; capital circulante; obligaciones por arrendamiento""",
}


def curated() -> list[tuple[str, str, float]]:
    """``(term, subject, weight)``, terms in lower case; a term of several languages counts once."""
    out: dict[tuple[str, str], float] = {}
    for subject, listed in TERMS.items():
        for entry in listed.replace("\n", " ").split(";"):
            words = entry.lower().split()
            weight = 1.0
            if words and words[-1].replace(".", "").isdigit():
                weight = float(words.pop())
            if words:
                out[" ".join(words), subject] = weight
    return [(term, subject, weight) for (term, subject), weight in out.items()]
