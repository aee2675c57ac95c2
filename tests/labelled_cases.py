"""Own cases for sentence ends: a text and, ``;``-separated, the pieces behind whose first occurrence a sentence ends inside the text (null: none)."""

CASES = [
    ("title-1", "Dr. Osgood examined the wound. It was clean.", "the wound."),
    ("title-2", "Mr. Penrose left early.", None),
    ("title-3", "Mrs. Quint and Ms. Rhodes spoke. Nobody answered.", "Rhodes spoke."),
    ("title-4", "Prof. Sayer retired in 1999. His office is empty.", "in 1999."),
    ("title-5", "The letter from Rev. Tate arrived. We read it aloud.", "Tate arrived."),
    ("title-6", "Sen. Upton and Gov. Vance disagree.", None),
    ("title-7", "Capt. Wilde gave orders. The crew obeyed. They sailed.", "gave orders.;crew obeyed."),
    ("firm-1", "Yarrow Inc. posted a loss. Investors fled.", "a loss."),
    ("firm-2", "Zeller Corp. hired ten people.", None),
    ("firm-3", "The suit names Abbot Co. and Birch Ltd. as parties.", None),
    ("firm-4", "She joined Cole Bros. in March. They pay well.", "in March."),
    ("firm-5", "Everyone at Drake L.L.C. was invited.", None),
    ("firm-6", "He retired from Eaton Inc. The party was fun.", "Eaton Inc."),
    ("initial-1", "J. K. Marlow wrote the book. It sold well.", "the book."),
    ("initial-2", "The poem is by T. S. Norton.", None),
    ("initial-3", "Harry S. Oakes was elected. Few were surprised.", "was elected."),
    ("acronym-1", "The U.S. team won. Fans cheered.", "team won."),
    ("acronym-2", "Imports to the U.K. fell sharply.", None),
    ("acronym-3", "The U.N. vote failed. Talks go on.", "vote failed."),
    ("time-1", "Doors open at 7 p.m. on Sunday.", None),
    ("time-2", "We met at 9 a.m. and talked. Then we ate.", "and talked."),
    ("time-3", "The train leaves at 6 a.m. We must hurry.", "6 a.m."),
    ("number-1", "It grew 2.5 percent. Analysts had hoped for more.", "percent."),
    ("number-2", "The price is $3.99 today.", None),
    ("number-3", "Pi is about 3.14159. It never ends.", "3.14159."),
    ("number-4", "Version 4.2 is out. Update soon.", "is out."),
    ("latin-1", "Some fruit, e.g. pears, keeps well.", None),
    ("latin-2", "He has one pet, i.e. a cat. It sleeps.", "a cat."),
    ("latin-3", "Bring pens, paper, etc. to the exam.", None),
    ("cite-1", "See Fig. 4 for details. The axis is time.", "for details."),
    ("cite-2", "Reed v. Stone was overruled.", None),
    ("cite-3", "Under sec. 9 the claim fails. The court agreed.", "claim fails."),
    ("cite-4", "It appears in vol. 3, no. 2, p. 14.", None),
    ("month-1", "On Feb. 3 the bridge closed. It reopened later.", "bridge closed."),
    ("month-2", "Sales in Sept. were flat.", None),
    ("street-1", "The bakery on Main St. is shut.", None),
    ("street-2", "They live on Park Ave. near the lake. It is quiet.", "the lake."),
    ("clean-1", "The dog barked. The cat ran.", "dog barked."),
    ("clean-2", "Rain fell all night. By dawn the river had risen. People left.", "all night.;had risen."),
    ("clean-3", "Is it late? I think so. Let us go.", "it late?;think so."),
    ("clean-4", "What luck! We found it.", "What luck!"),
    ("clean-5", "One sentence only.", None),
    ("clean-6", "No mark at the end", None),
    ("clean-7", "The choir sang; the crowd stood.", None),
    ("clean-8", "He came, he saw, he left. That was all.", "he left."),
    ("quote-1", '"We are done." She closed the book.', 'are done."'),
    ("quote-2", '"Who is it?" asked the guard.', None),
    ("quote-3", "“Not now,” he said. “Later.”", "he said."),
    ("quote-4", "“Go away!” The door slammed.", "Go away!”"),
    ("quote-5", 'They call it "the shed" for fun. It is huge.', "for fun."),
    ("quote-6", "She said, “I know.” Then she smiled.", "I know.”"),
    ("quote-7", "It's the cook's day off. Order in.", "day off."),
    ("bracket-1", "He agreed (see page 9) and signed. We left.", "and signed."),
    ("bracket-2", "(All of it is true.) Nobody doubts it.", "is true.)"),
    ("bracket-3", "The list (names, dates, etc.) is long.", None),
    ("ellipsis-1", "I thought... perhaps not.", None),
    ("ellipsis-2", "He paused… Then he spoke.", "He paused…"),
    ("break-1", "First line ends here.\nSecond line starts. Third.", "ends here.;line starts."),
    ("break-2", "A heading of sorts.\n\nThe body follows.", "of sorts."),
    ("mixed-1", "Dr. Lund of Moss Inc. paid $2.50 at 8 a.m. on Jan. 4. Mr. Nye objected.", "Jan. 4."),
    ("mixed-2", "Gen. Orr met Sen. Pike in Washington, D.C. on Monday. They shook hands.", "on Monday."),
    ("mixed-3", "St. Croix is small. Mt. Vale is not.", "is small."),
    ("mixed-4", "Who wrote to Ms. Quade? It was Lt. Rusk!", "Quade?"),
    ("accents-1", "Élodie est là. À demain.", "est là."),
    ("web-1", "Visit example.org today. It is free.", "today."),
    ("degree-1", "She has a Ph.D. in physics. Her brother does not.", "in physics."),
]
