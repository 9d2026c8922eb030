"""Fragments for each rule of the block cleaner, and what must become of them, written by hand; § stands for a value of the row."""

#: Rule -> (raw fragment, clean fragment).
RULE_CASES = {
    "h1": ("<p>50%25 off § + more</p>", "<p>50% off § + more</p>"),
    "h2": ("<p>ItÂ\u0092s §Â\u0080</p>", "<p>It’s §</p>"),
    "h3": ("<p>say \\\"§\\\" and a\\/b</p>", "<p>say \"§\" and a/b</p>"),
    "h4": ("<p>§ stays</p>!*!<p>gone</p>", "<p>§ stays</p>"),
    "h5": ("<p>§ [[slot]] and {{x}} end</p>", "<p>§ and end</p>"),
    "h6": ("<p>See https://x.example/§ now</p>", "<p>See <a>https://x.example/§</a> now</p>"),
    "h7": ("<p>this is **very §** good</p>", "<p>this is <strong>very §</strong> good</p>"),
    "h8": ("<p>one §<p>two</div>", "<p>one §</p><p>two</p>"),
    "h9": ("<div>first §</div><div>second line</div>", "<p>first §</p><p>second line</p>"),
    "h10": ("<div><span><section><p>deep §</p></section></span></div>", "<p>deep §</p>"),
    "h11": ('<p class="x" style="y">§ plain <a href="z" target="q">link</a></p>', "<p>§ plain <a>link</a></p>"),
    "h12": ("<p><b>Duties<br>Skills §</b></p>", "<h3>Duties</h3><h3>Skills §</h3>"),
    "h13": ("<p>we <b>really <b>need §</b></b> you</p>", "<p>we <strong>really need §</strong> you</p>"),
    "h14": ("<p><b>Who</b> <b>We Are §</b></p>", "<h3>Who We Are §</h3>"),
    "h15": ("<p><b>Key Duties §</b></p><p>Do it well.</p>", "<h3>Key Duties §</h3><p>Do it well.</p>"),
    "h15 tracking": ("<p>Real § text. <b>#LI-XY1</b></p>", "<p>Real § text.</p>"),
    "h16": ("<li>one §</li><li>two</li>", "<ul><li>one §</li><li>two</li></ul>"),
    "h17": ("<p><b>Place:</b> Paris § <b>Hours:</b> 40</p>", "<p><strong>Place:</strong> Paris §</p><p><strong>Hours:</strong> 40</p>"),
    "h18": ("<p>line one §<br><br>line two</p>", "<p>line one §</p><p>line two</p>"),
    "h18 bold": ("<p>We do § well. <b>Our Offer</b> Good pay.</p>", "<p>We do § well.</p><h3>Our Offer</h3><p>Good pay.</p>"),
    "h19": ("<p><b>Place:</b> Paris § <b>Our Offer</b></p>", "<p><strong>Place:</strong> Paris §</p><h3>Our Offer</h3>"),
    "h20": ("<p>para one §\n\npara two</p>", "<p>para one §</p><p>para two</p>"),
    "h21": ("<p><b>Benefits §</b> We offer much.</p>", "<h3>Benefits §</h3><p>We offer much.</p>"),
    "h21 label": ("<p><b>Pay §:</b> 30 an hour</p>", "<p><strong>Pay §:</strong> 30 an hour</p>"),
    "h21 dash": ("<p><b>Pay § -</b> Thirty an hour</p>", "<p><strong>Pay § -</strong> Thirty an hour</p>"),
    "h21 goes on": ("<p><b>Our § Team</b> is large.</p>", "<p><strong>Our § Team</strong> is large.</p>"),
    "h22": ("<p>text § <h3>Head Here</h3> more</p>", "<p>text §</p><h3>Head Here</h3><p>more</p>"),
    "h23": ("<p>a § <p>b</p></p>", "<p>a §</p><p>b</p>"),
    "h24": ("naked § text", "<p>naked § text</p>"),
    "h25": ("<ul><li><h3>A §</h3></li><li>x</li><li>Note:</li><li><h3>B</h3></li><li>y</li></ul>", "<h3>A §</h3><ul><li>x</li></ul><h3>B</h3><ul><li>y</li></ul>"),
    "h26": ("<h3>Same §</h3><p> </p><h3>same §</h3><p>t.</p>", "<h3>same §</h3><p>t.</p>"),
    "h27": ("<p>all <b>bold §</b> here</p>", "<p>all <strong>bold §</strong> here</p>"),
    "h28": ("<p>wide   §\n  gap</p>", "<p>wide § gap</p>"),
    "h29": ("<p>OUR OFFER • pay § • leave</p>", "<h3>OUR OFFER</h3><ul><li>pay §</li><li>leave</li></ul>"),
    "h30": ("<ul><li>Home</li><li>Search</li></ul><p>Real § text.</p>", "<p>Real § text.</p>"),
    "h31": ("<p>Apply now</p><p>Job ID: §</p><h3>Menu</h3><p>Real § text.</p>", "<p>Real § text.</p>"),
    "h31 list": ("<p>Job Description</p><ul><li>x §</li></ul>", "<p>Job Description</p><ul><li>x §</li></ul>"),
    "h32": ("<h3>Toronto, ON</h3><p>Real § text.</p>", "<p>Toronto, ON</p><p>Real § text.</p>"),
    "h33": ("<p>Overview:</p><h3>Duties §</h3><p>Do.</p>", "<h3>Duties §</h3><p>Do.</p>"),
    "h34": ("<p></p><p>Salary:</p><p>42</p><p>Real § text.</p>", "<p>Real § text.</p>"),
    "h35": ("<p>x <u>under §</u> <i>it</i></p>", "<p>x under § it</p>"),
    "h36": ("<p>see<strong>bold §</strong>text</p>", "<p>see <strong>bold §</strong> text</p>"),
    "h37 phone": ("<p><b>555 123 4567</b></p><p>Real § text.</p>", "<p><strong>555 123 4567</strong></p><p>Real § text.</p>"),
    "h37 small": ("<p><b>we hire §</b></p>", "<p><strong>we hire §</strong></p>"),
    "h37 place": ("<p><b>Vancouver §, BC</b></p>", "<p><strong>Vancouver §, BC</strong></p>"),
    "h37 sentence": ("<p><b>Join us § today!</b></p>", "<p><strong>Join us § today!</strong></p>"),
    "h37 words": ("<p><b>One two three four five six seven §</b></p>", "<p><strong>One two three four five six seven §</strong></p>"),
    "h37 reference": ("<p><b>Posting #7 §</b></p>", "<p><strong>Posting #7 §</strong></p>"),
}

#: Raw fragment -> (text of the cleaned one without separators, with blanks between its nodes, lines of the raw one).
TEXT_CASES = [
    ("<p>a <b>b §</b></p><p>c &amp; d.</p>", "a b §c & d.", "a  b § c & d.", "a \nb §\nc & d."),
    ("<ul><li>x §</li><li>y</li></ul>", "x §y", "x § y", "x §\ny"),
    ("<script>no</script><p>seen §</p>", "seen §", "seen §", "seen §"),
]

#: Raw fragment -> (marked dates with whether they are starts, marked addresses with their contexts).
MARK_CASES = [
    ('<h3>Start date</h3><p><span class="hl-date">§-05-01</span></p>', [("§-05-01", True)], []),
    ('<p>Deadline <span class="hl-date">§-04-01</span> or <span class="x hl-date">§-05-01</span></p>', [("§-04-01", False), ("§-05-01", False)], []),
    ('<p>du <span class="hl-date">§-04-01</span></p>', [("§-04-01", True)], []),
    ('<p>For help</p><p>mail <span class="hl-email">a§@b.co</span></p>', [], [("a§@b.co", "For help mail a§@b.co")]),
    ("<p>no marks §</p>", [], []),
]
