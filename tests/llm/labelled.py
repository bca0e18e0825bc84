"""Texts labelled by hand. No name, street or firm in them occurs in the test tables."""

#: (text, values that stand in it)
LABELLED = [
    ("The witness, Mr. Okonkwo, spoke first.", {("person_name", "Okonkwo")}),
    ("Counsel was Ms. Nguyen. She agreed with John Smith and Maria Gonzalez.", {("person_name", "Nguyen"), ("person_name", "John Smith"), ("person_name", "Maria Gonzalez")}),
    ("Mrs. Abernathy lives at 1345 Bexhill Terrace, Norwich NR4 2QQ.", {("person_name", "Abernathy"), ("street_address", "1345 Bexhill Terrace, Norwich NR4 2QQ")}),
    ("Herr Müller und Frau Schneider sagten aus.", {("person_name", "Müller"), ("person_name", "Schneider")}),
    ("Me Dupont, avocat de Mme Lefebvre, a parlé.", {("person_name", "Dupont"), ("person_name", "Lefebvre")}),
    ("Mr. Wu and Ms. Li signed.", {("person_name", "Wu"), ("person_name", "Li")}),
    ("According to Dr. Priya Raman, the boiler had been serviced in May 2011.", {("person_name", "Priya Raman")}),
    ("The claimant, Mr. Callum Fraser, worked for Whitfield Engineering Ltd until 3 March 2009.", {("person_name", "Callum Fraser")}),
    ("The judge accepted that Ms. Haddad had never met Mr. T. Lindqvist.", {("person_name", "Haddad"), ("person_name", "T. Lindqvist")}),
    ("Marlow Shipping plc supplied 40 crates to Denholm Freight Ltd between 3 May 2001 and 4 June 2002.", set()),
    ("The appeal was allowed by the Court of Appeal. Section 12 of the Limitation Act 1980 did not apply.", set()),
    ("Mr. Justice Abiola gave judgment. Abiola J said that the notice was late.", {("person_name", "Abiola")}),
    ("Prof. Ingrid Sørensen was called as an expert. Sørensen's report was served on 4 June 2010.", {("person_name", "Ingrid Sørensen"), ("person_name", "Sørensen")}),
    ("Write to rosalind.achebe@lawyers.example.net or call +44 20 7946 0991 for Mrs. Rosalind Achebe.", {("email", "rosalind.achebe@lawyers.example.net"), ("phone", "+44 20 7946 0991"), ("person_name", "Rosalind Achebe")}),
    ("Dr. Petrovic, who lives at 88 Juniper Road, Leeds LS6 4QT, received it.", {("person_name", "Petrovic"), ("street_address", "88 Juniper Road, Leeds LS6 4QT")}),
    ("A card with passport no. PK 443 9012 in the name of Mr. Samuel Osei was found.", {("id_number", "PK 443 9012"), ("person_name", "Samuel Osei")}),
    ("The lease of the cold store was surrendered on 12 May 2004. The deposit was never returned.", set()),
    ("Mr. Esteban Quiroga told the inspector that Ms. Adeyemi had overlooked the ledger.", {("person_name", "Esteban Quiroga"), ("person_name", "Adeyemi")}),
    ("Frau Dr. Annegret Wischnewski wohnte in der Kastanienallee 17, 50667 Köln.", {("person_name", "Annegret Wischnewski"), ("street_address", "Kastanienallee 17, 50667 Köln")}),
    ("Der Zeuge Herr Jürgen Oberhauser erklärte, die Lieferung sei am 4. Mai 2009 eingetroffen.", {("person_name", "Jürgen Oberhauser")}),
    ("Die Klägerin verlangt Schadensersatz. Der Senat folgt dem nicht.", set()),
    ("Die Baumgart GmbH lieferte in 12 Teilmengen, zuletzt am 6. November 2001.", set()),
    ("Nach Angaben von Frau Yilmaz war Herr Kowalczyk verreist.", {("person_name", "Yilmaz"), ("person_name", "Kowalczyk")}),
    ("Rechtsanwalt Tillmann Reuter vertrat Frau Sibel Arslan.", {("person_name", "Tillmann Reuter"), ("person_name", "Sibel Arslan")}),
    ("Herr Wagenknecht zahlte nichts. Wagenknecht war unter 0211 4477881 erreichbar.", {("person_name", "Wagenknecht"), ("phone", "0211 4477881")}),
    ("M. Benoît Lacombe, demeurant 14 rue des Acacias, 69003 Lyon, a été entendu.", {("person_name", "Benoît Lacombe"), ("street_address", "14 rue des Acacias, 69003 Lyon")}),
    ("Mme Camille Roussel était joignable au 04 72 55 18 90.", {("person_name", "Camille Roussel"), ("phone", "04 72 55 18 90")}),
    ("La société Garonne Transports SARL a livré 12 caisses avant le 3 mars 2010.", set()),
    ("Me Sylvain Carpentier a plaidé pour Mme Nadia Belkacem.", {("person_name", "Sylvain Carpentier"), ("person_name", "Nadia Belkacem")}),
    ("Selon M. Thierry Vasseur, le congé avait été signé le 4 juin 2009. Vasseur n'a rien ajouté.", {("person_name", "Thierry Vasseur"), ("person_name", "Vasseur")}),
    ("The letter was addressed to Mrs. Beatrix Halloway-Finch, 7 Corbett Close, Derby DE1 3GH.", {("person_name", "Beatrix Halloway-Finch"), ("street_address", "7 Corbett Close, Derby DE1 3GH")}),
    ("See Ramsbottom v Thistlewood (2001) 12 Eastm. L.R. 44, at [9].", set()),
    ("Mr. Dmitri Volkov and Miss Chiara Bianchi signed the charter.", {("person_name", "Dmitri Volkov"), ("person_name", "Chiara Bianchi")}),
    ("Contact: o.fitzwilliam (at) counsel (dot) example, 020 7946 0123.", {("email", "o.fitzwilliam (at) counsel (dot) example"), ("phone", "020 7946 0123")}),
    ("The tenant told Sir Humphrey Appleton that the roof leaked. Appleton denied it.", {("person_name", "Humphrey Appleton"), ("person_name", "Appleton")}),
]
