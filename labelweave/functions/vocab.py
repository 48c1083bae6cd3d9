"""Vocabularies of the text cleaner."""

# These word lists decide which words survive and must stay as they are.
NOISE_WORDS = """
the a an and or but in on at to for of with by from as is was are were be been being have has had do does did will
would should could may might can this that these those it its they them their we our you your page section chapter
figure table example exercise problem click see show here there where when who what which how why
""".split()

# Words that are always kept.
KEEP_WORDS = """
exponent power scientific notation multiply divide convert decimal integer rational irrational square cube root volume
area surface cylinder cone sphere pyramid circle triangle angle pythagorean theorem formula explain derive calculate
solve estimate approximate model design geometric apply operation add subtract fraction equation expression variable
coefficient term factor product sum difference quotient slope intercept graph function domain range coordinate axis
origin perpendicular parallel congruent similar transformation reflection rotation translation dilation scale
proportion ratio percent probability statistics mean median mode standard deviation distribution sample population
""".split()

# Fixed value: how many surviving words are kept per text.
MAX_WORDS = 150
