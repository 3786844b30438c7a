"""Case files written out from the star schema, so that every French-language job has whole
tables to work on: one document per customer, one page per order.

The SQL runs unchanged on Spark and on DuckDB. Pages grow with ``orders``, persons with
``customer``; a case is a nation.
"""

FIRST = ("Jean,Marie,Paul,Claire,Luc,Anne,Marc,Julie,René,Sophie,Hugo,Léa,Louis,Inès,Noé,Zoé,Éric,Alice,"
         "Rémi,Jeanne")
LAST = ("DUPONT,MARTIN,BERNARD,PETIT,DURAND,LEROY,MOREAU,SIMON,LAURENT,LEFÈVRE,GARNIER,FAURE,ROUSSEAU,BLANC,"
        "GUÉRIN,MULLER,HENRY,ROUSSEL,NICOLAS")
MONTHS = "janvier,février,mars,avril,mai,juin,juillet,août,septembre,octobre,novembre,décembre"


def two(expr: str) -> str:
    return f"lpad(cast({expr} as string), 2, '0')"


def pick(words: str, expr: str) -> str:
    return f"split_part('{words}', ',', cast({expr} as int))"


NAMES = f"""
SELECT c_custkey, concat('N', c_nationkey) AS case_id,
  {pick(FIRST, 'c_custkey % 20 + 1')} AS first_name,
  concat({pick(LAST, 'c_custkey % 19 + 1')}, c_custkey) AS last_name,
  CASE WHEN c_custkey % 4 = 0 THEN concat('PV ', 2001 + c_custkey % 20, '-05-17 n', c_custkey, '.pdf')
       WHEN c_custkey % 4 = 1 THEN concat('IDENTITE_', c_custkey, '.pdf')
       ELSE concat('dossier_', c_custkey, '.txt') END AS source,
  concat({two('c_custkey % 97')}, ' ', {two('c_custkey % 89')}, ' ', {two('c_custkey % 83')}, ' ',
         {two('c_custkey % 79')}) AS tail
FROM customer"""

PAGES = f"""
SELECT case_id, source, page, CASE t
  WHEN 0 THEN concat('PROCÈS-VERBAL D''AUDITION DE ', full_name, '\n', 'Fait à Paris, le ', dmy, ' à 14h30.\n',
    'Entendu, ', full_name, ' déclare que le numéro de ', full_name, ' est le ', phone, '. Première audition de ',
    full_name, ', né le 12/03/1980 à Lyon, de nationalité française, demeurant au ', page % 90 + 1, ' rue de la Paix.')
  WHEN 1 THEN concat('VÉRIFICATION D''IDENTITÉ\n', 'NOM : ', last_name, '\n', 'PRÉN0M : ', first_name, '\n',
    'DATE ET LIEU DE NAISSANCE : ', dmy, ' à Paris\n', 'NATIONALITÉ : française\n', 'PROFESSION : artisan\n', 'du bâtiment\n',
    'FILIATION : inconnue\n', 'ADRESSE : ', page % 90 + 1, ' rue Victor Hugo, Lyon')
  WHEN 2 THEN concat('Suite du dossier. ', full_name, ' est domicilié au ', page % 7 + 1, ' avenue Foch, Lille. Il est né le 5 juin 1980 ',
    'à Marseille. Virement vu le ', ymd, ' à 9h05 sur le compte FR76', 3000600001 + page % 1000, '12345678901 de ', full_name, '.')
  WHEN 3 THEN concat('RAPPORT D''ENQUÊTE\n', 'Le véhicule immatriculé ', plate, ' utilisé par ', full_name, ' est vu le ', words,
    ' à ', page % 24, 'h15. Trace relevée sur la plaque. Un autre véhicule, 123 ABC 75, part à 25h99.')
  WHEN 4 THEN concat('Transcription des écoutes\n', 'Conversation avec ', full_name, ' : appel reçu le ', words, ', ligne au nom de ',
    full_name, ', au ', phone, ' puis au ', phone, '. Lien t.me/user_', c_custkey, ' et wa.me/33600', page % 1000, ' ; snap : snapchat.com/add/u',
    c_custkey, '.')
  WHEN 5 THEN concat('EXPERTISE GÉNÉTIQUE\n', 'Profil génétique concordant avec ', full_name, '. Empreintes relevées sur la douille. ',
    'Étude balistique du ', dmy, '. Aucune empreinte sur la porte.')
  WHEN 6 THEN concat('Commission rogatoire, perquisition chez ', last_name, ' ', first_name, '. Bornage du téléphone concordant. ',
    'Pose de balise. Adresse IP 10.', page % 250, '.', c_custkey % 250, '.7 : connexion. Courriel ', 'u', c_custkey, '@Example.com, joint.')
  WHEN 7 THEN concat('Garde à vue. ', full_name, ' est entendu ; alibi vérifié, vu ailleurs le ', ymd, ' ! Aucun lien ? ',
    'Le prévenu, connu sous le nom de ', last_name, ', est joignable au ', phone, '. Fin.')
  WHEN 8 THEN concat('NOTE DE SYNTHÈSE\n', repeat(concat('Le dossier ', c_custkey, ' reste ouvert et la pièce numéro ', page,
    ' est jointe au scellé. Elle ne nomme personne ! '), 12), 'Virement de ', full_name, ' reconnu.')
  ELSE '' END AS text
FROM (
  SELECT n.case_id, n.source, n.c_custkey, n.first_name, n.last_name, concat(n.first_name, ' ', n.last_name) AS full_name,
    o.o_orderkey AS page, o.o_orderkey % 10 AS t,
    concat({two('day(o.o_orderdate)')}, '/', {two('month(o.o_orderdate)')}, '/', year(o.o_orderdate)) AS dmy,
    concat(year(o.o_orderdate), '-', {two('month(o.o_orderdate)')}, '-', {two('day(o.o_orderdate)')}) AS ymd,
    concat(day(o.o_orderdate), ' ', {pick(MONTHS, 'month(o.o_orderdate)')}, ' ', year(o.o_orderdate)) AS words,
    CASE o.o_orderkey % 3 WHEN 0 THEN concat('06 ', n.tail) WHEN 1 THEN concat('+33 (0)6 ', n.tail)
      ELSE concat('06.', replace(n.tail, ' ', '.')) END AS phone,
    concat(substr('ABCDEFGH', cast(n.c_custkey % 8 + 1 as int), 1), 'B-', lpad(cast(n.c_custkey % 1000 as string), 3, '0'), '-',
           substr('KLMNPQRS', cast(n.c_custkey % 8 + 1 as int), 1), 'Z') AS plate
  FROM orders o JOIN ({NAMES}) n ON o.o_custkey = n.c_custkey)"""

PERSONS = f"""
SELECT c_custkey AS person_id, case_id, concat(first_name, ' ', last_name) AS name, source, last_name FROM ({NAMES})"""
