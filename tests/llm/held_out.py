"""Sentences written for the test of personal information, in phrasings of letters, reports and forums: given
names that stand in none of the operator's lists (some family names have a listed ending), numbers and
addresses. `[kind|text]` marks an item."""

from __future__ import annotations

import re

NAMES = """
Xiomara Castillo;Siobhan O'Rourke;Prakash Iyer;Chukwuemeka Adeyemi;Gillian Cooper;Thaddeus Okonkwo;Marguerite Delacroix;Ingvild Haugen;
Bronwyn Pritchard;Lucinda Featherstone;Desmond Achebe;Yevgenia Sokolova;Hiroshi Takahashi;Mei-Ling Chow;Radoslav Petkov;Aoife Gallagher;
Tomasz Wierzbicki;Saoirse Brennan;Nasreen Qureshi;Emeka Obi;Valentina Rossi;Gunnar Dahl;Zainab Hussain;Cormac Doyle;Beatriz Navarro;
Rupert Ashdown;Philippa Langley;Anjali Deshpande;Florian Maier;Katarzyna Nowak;Svetlana Morozova;Rosalind Hughes;Winston Baptiste;
Dieter Vogel;Ottilie Krause;Leopold Steiner;Nkechi Eze;Farouk Mansour;Hortense Lambert;Gaetano Ferrara;Delphine Mercier;Jerome Whitaker;
Priscilla Boateng;Malachy Burke;Isolde Brandt;Evander Blake;Clementine Shaw;Ignatius Doherty;Petronella Jansen;Lorcan Keane
"""
NAME_LINES = """
Mrs {} rang this morning about the boiler.|Please pass the file on to Mr {} before noon.|The letter was signed by {} on Monday.
Dear {}, thank you for your message of last week.|Yesterday {} told the court that he had seen nothing.|We spoke to {} at the counter.
Contact {} for an appointment.|I met {} at the station and we walked home.|According to {}, the bridge was closed all winter.
Dr. {} will see you at nine.|Ask for {} when you arrive.|The winner, {}, took home a small cup.
Kind regards, {}|In the end {} said nothing at all.|Her neighbour {} has lived there since the war.
Thanks to {} for the photographs.|My colleague {} wrote the second chapter.|Patient: {}
The claim of {} was rejected without a hearing.|Prof {} moved to the new building.|Attention: {}
A parcel for {} is waiting downstairs.|Only {} knew where the key was.|Our driver, {}, called in sick.
Applicant: {}|Then {} went back to the kitchen.|The report names {} as a witness.
"""
OTHERS = """
Write to [email|x.castillo@posteo.example] for a copy.|His address is [email|rupert_ashdown99@mail-host.co.example] and he answers quickly.
Send it to [email|office+claims@kanzlei-vogel.example] please.|You can reach me at [email|n.eze@uni.example], but not at weekends.
Forward everything to [email|delphine.mercier@cabinet.example].|Questions go to [email|help.desk@gemeinde.example] only.
Call [phone|+44 20 7946 0321] after six.|My mobile is [phone|07700 900461] if anything comes up.|Phone: [phone|(415) 555-0132]
Ring [phone|+49 30 901820 55] and ask for the porter.|Tel. [phone|+33 1 70 18 99 21]|You can text [phone|212-555-0187] at any time.
Her number is [phone|+1 604 555 0199], day or night.|Fax [phone|020 7946 0998]
Her social security number is [id_number|219-09-9412].|Insurance number [id_number|JK 42 71 93 B] was quoted twice.
Passport [id_number|K48213907] was found in the taxi.|DNI [id_number|48213907K] caducado.|His tax number is [id_number|37 482 913 605].
Please quote national insurance number [id_number|AB 12 98 34 D].|SSN: [id_number|078-05-1127]
He lives at [address|221B Baker Street, London NW1 6XE] with a friend.|Deliver to [address|14 Orchard Lane, Ripon HG4 2QP] by Friday.
Our office is at [address|350 Juniper Avenue, Boulder CO 80302] now.|They moved to [address|7 Priory Road, Malvern WR14 3DN] in spring.
Visit us at [address|Lindenstraße 14, 10969 Berlin] on weekdays.|Adresse: [address|Goethestr. 8, 60313 Frankfurt]
Elle habite [address|12 rue des Lilas, 69003 Lyon] depuis un an.|Vive en [address|Calle Mayor 22, 28013 Madrid] con su hermana.
Il negozio si trova in [address|Via Garibaldi 12, 20121 Milano] da anni.|Biuro mieści się przy [address|ul. Długa 10, 00-590 Warszawa] od maja.
The shop at [address|88 Castle Terrace, Edinburgh EH1 2DP] has closed.|Send post to [address|Flat 3, 19 Mill Road, Cambridge CB1 2AD] instead.
"""
NONE = """
The Northern Railway closed in 1963.|Order 4417-2290 was shipped on 12.03.2021.|Chapter Three begins in a small town.|Version 10.4.2 fixes the problem.
Total revenue rose to 1,204,551 in March.|The Royal Society met on Tuesday.|Part number 88-213-0042 is out of stock.|Sales in South Africa doubled.
Windows Update failed again.|Invoice 2021-00417 is overdue.|She bought 12 oranges and 3 lemons at the market.|Serial 0049218837 does not fit.
The Treaty of Lisbon was signed there.|He reads the Financial Times on the train.|Machine Learning is taught on Mondays.|Room 214 is on the second floor.
It costs 14.99 a month.|See page 112 for the map.|The ratio is 16:9 at 60 frames.|Lake Geneva froze over.
"""


def sentences() -> list[tuple[str, list[tuple[str, str]]]]:
    """(sentence, [(kind, item)]): 250 sentences."""
    names = [n for n in re.split(r"[;\n]+", NAMES) if n]
    lines = [x for x in re.split(r"[|\n]+", NAME_LINES) if x]
    out = []
    for i in range(4 * len(names)):
        name = names[i % len(names)]
        out.append((lines[(i * 7) % len(lines)].format(name), [("name", name)]))
    for x in re.split(r"\n|(?<=[.\]y])\|(?=[A-Z])", OTHERS):
        if x:
            items = re.findall(r"\[(\w+)\|([^\]]+)\]", x)
            out.append((re.sub(r"\[\w+\|([^\]]+)\]", r"\1", x), items))
    out += [(x, []) for x in re.split(r"[|\n]+", NONE) if x]
    return out
