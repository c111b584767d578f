"""Small pages for each check with the problems and nodes that it must give, derived by hand."""

_DATA = "<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>"
_HEAD = "<table><tr><th>a</th><th>b</th></tr><tr><td>c</td><td>d</td></tr></table>"
_NEST = "<table><tr><td><table><tr><td>a</td></tr></table></td></tr></table>"
_FORM = "<table><tr><td><input></td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>"
_FLAT = "<table><tr><td>a</td></tr><tr><td>b</td></tr></table>"
_CORNER = "<table><tr><td>x</td><th>a</th><th>b</th></tr><tr><th>c</th><td>1</td><td>2</td></tr></table>"
_MIXED = "<table><tr><th>a</th><td>b</td></tr><tr><td>c</td><th>d</th></tr></table>"
_ART = "＿／＼" * 12
_5 = "<!DOCTYPE html>"
_4 = '<!DOCTYPE html PUBLIC "-//W3C//DTD HTML 4.01//EN" "http://www.w3.org/TR/html4/strict.dtd">'

#: (check, html, problems, nodes of all of them).
CASES = [
    ("C_3.0", "<img longdesc='d.html'>", 1, 1), ("C_3.0", "<img longdesc='D.html'><a href='d.html'> D </a>", 0, 0), ("C_3.0", f"{_5}<img longdesc='d.html'>", 0, 0), ("C_3.0", "<img longdesc=''>", 0, 0),
    ("C_6.0", f"<p>{_ART}</p>", 1, 1), ("C_6.0", f"<p>{_ART}{'word' * 9}</p>", 0, 0), ("C_6.0", f"<div>{_ART}<p>x</p></div>", 0, 0), ("C_6.1", f"<p>{_ART}</p>", 1, 1), ("C_6.1", "<p>＿／</p>", 0, 0), ("C_69.0", f"<td>{_ART}</td><p>{_ART}</p>", 1, 1), ("C_69.0", "<p>x</p>", 0, 0),
    ("C_14.0", "<h2>a</h2><h4>b</h4>", 1, 2), ("C_14.0", "<h2>a</h2><h3>b</h3><h1>c</h1>", 0, 0),
    ("C_18.2", "<q cite=''>longer than ten</q><blockquote>x</blockquote>", 2, 2), ("C_18.2", "<q>short</q><blockquote cite='u'>x</blockquote>", 0, 0),
    ("C_33.0", "<blink> </blink>", 1, 1), ("C_33.0", "<blink><b></b></blink>", 0, 0), ("C_33.1", "<p style='TEXT-decoration : blink'></p>", 1, 1), ("C_33.1", "<p style='text-decoration:none; x:blink'>a</p>", 0, 0),
    ("C_33.2", "<style>p { text-decoration: blink }</style>", 1, 1), ("C_33.2", "<style>text-decoration: blink</style>", 0, 0), ("C_34.0", "<marquee></marquee>", 1, 1), ("C_34.0", "<p></p>", 0, 0),
    ("C_36.0", "<meta http-equiv=Refresh content='5'>", 1, 1), ("C_36.0", "<meta http-equiv=refresh content='5; URL=/x'>", 0, 0), ("C_36.1", "<meta http-equiv=refresh content='5; url=/x'>", 1, 1), ("C_36.1", "<meta http-equiv=refresh content=' 5; url=/x'><meta http-equiv=refresh content='5 url=/x'><meta http-equiv=refresh content='0;url=/x'>", 0, 0),
    ("C_51.0", "<frameset><frame><frame title=''></frameset>", 1, 1), ("C_51.4", "<frameset><frame><frame title='　'></frameset>", 1, 1), ("C_51.1", "<iframe src=u></iframe>", 1, 1), ("C_51.1", "<iframe title=''></iframe>", 0, 0), ("C_51.5", "<iframe title=' '></iframe>", 1, 1), ("C_51.5", "<iframe title='a'></iframe>", 0, 0),
    ("C_51.2", "<frameset><frame title='a'><frame></frameset>", 1, 1), ("C_51.3", "<iframe title='a'></iframe><iframe title=' '></iframe>", 1, 1), ("C_52.0", "<frameset><frame title=' '><frame title=a longdesc=u></frameset>", 1, 1), ("C_52.1", "<iframe title='a' longdesc=''></iframe><iframe></iframe>", 1, 1),
    ("C_57.3", "<a href=u title=' '>a</a>", 1, 1), ("C_57.3", "<a title=' '>a</a>", 0, 0), ("C_57.2", "<a href='/a'><span></span></a>", 1, 1), ("C_57.2", "<a href='/a'><span></span></a><a href='/a'>n</a>", 0, 0), ("C_57.2", "<a href='/a' title='t'><span></span></a><a href='/b'></a><a href='#c'><b></b></a><a href='/d' aria-label='n'><b></b></a>", 0, 0),
    ("C_57.2", "<a href='/a'><script></script><noscript>x</noscript></a>", 0, 0), ("C_57.5", "<a href='/a'><span></span></a><a href='/a'>n</a>", 1, 1), ("C_57.5", "<a href='/a' title='t'><span></span></a><a href='/a'>n</a>", 0, 0), ("C_57.6", "<a href='/e'></a><a href='/e'></a><a href='/f'></a>", 2, 3), ("C_57.6", "<a href='#e'></a><a href='/e' title='t'></a>", 0, 0),
    ("C_57.0", "<a href=a>short</a><a href=b title=''>two words</a>", 1, 2), ("C_57.0", "<a href=a title='t'>short</a><a href=b>one two three</a><a href=c>twenty characters or more</a>", 0, 0), ("C_57.0", "<a href=a aria-label='name'><b></b></a>", 1, 1),
    ("C_57.1", "<a href=a title='t'>short</a><a href=b title='t'></a>", 2, 2), ("C_57.1", "<a href=a title='one two three'>short</a><a href=a title='t'>one two three</a>", 0, 0), ("C_57.4", "<a href=a title='t'>x</a>", 1, 1), ("C_57.4", "<a href=a title=' '>x</a>", 0, 0),
    ("C_85.0", "<video autoplay></video><audio autoplay='x'></audio>", 1, 2), ("C_85.0", "<video autoplay='FALSE'></video><video></video>", 0, 0),
    ("C_89.0", "", 1, 0), ("C_89.0", "<div title='t'></div>", 0, 0), ("C_89.0", "<p>&nbsp; </p>", 1, 0), ("C_89.0", "<frameset><frame></frameset>", 0, 0), ("C_89.2", "hi", 1, 0), ("C_89.2", "hi<img>", 0, 0), ("C_89.2", "<p>" + "x" * 50 + "</p>", 0, 0), ("C_89.1", "hi<img>", 1, 0), ("C_89.1", "hi", 0, 0),
    ("C_331.0", _MIXED, 1, 2), ("C_331.0", _HEAD, 0, 0), ("C_331.0", _CORNER, 0, 0), ("C_331.0", _MIXED.replace("<td>", "<td headers='h'>"), 0, 0), ("C_331.0", "<table><tr><th>x</th><th>a</th></tr><tr><th>c</th><td>1</td></tr></table>", 1, 1),
    ("C_331.1", _HEAD.replace("<th>a", "<th scope='COL'>a"), 1, 1), ("C_331.1", _HEAD.replace("<th>a", "<th scope='colgroup'>a"), 0, 0), ("C_331.1", "<table><tr><th scope='x'>a</th></tr></table>", 0, 0), ("C_331.2", _CORNER, 1, 1), ("C_331.2", _CORNER.replace("x", " "), 0, 0),
    ("C_332.1", _DATA.replace("<td>d", "<td headers='no'>d"), 1, 1), ("C_332.1", _DATA.replace("<td>d", "<td headers='no'>d") + _DATA, 2, 2), ("C_332.1", _DATA.replace("<td>d", "<td id='y' headers='y'>d"), 0, 0), ("C_332.2", "<p id='y'></p><p id='y'></p>" + _DATA.replace("<td>d", "<td headers='y'>d"), 1, 1), ("C_332.2", _DATA, 0, 0),
    ("C_422.0", "<a accesskey='k' href='a'>1</a><b accesskey='k'>2</b>", 1, 2), ("C_422.0", "<a accesskey='k'>1</a><b accesskey='K'>2</b>", 0, 0), ("C_423.0", "<p id='x'>a</p><p id='x'>b</p>", 1, 2), ("C_423.0", "<div><p id='x'>a</p><p id='x'>b</p></div>", 0, 0),
    ("C_13.0", "<font size=3>a</font><table width=10><tr height='5'><td width='5%'>x</td></tr></table>", 3, 3), ("C_13.0", "<font size='+1'>a</font><font size=''>a</font><table width=''><tr><td height='9%'>x</td></tr></table>", 0, 0),
    ("C_23.2", _NEST.replace("<table>", "<table summary='s'>") + _FORM.replace("<td>b", "<th>b"), 1, 3), ("C_23.2", _NEST + _HEAD, 0, 0),
    ("C_38.0", "<p onclick='x'>a</p><p ondblclick='x'>a</p><p onmouseover='x'>b</p>", 2, 3), ("C_38.0", "<p onclick='x' onkeyup='y' onmouseover='z'>a</p><p onmousemove='x' onselect='y'>b</p>", 0, 0),
    ("C_46.0", "<a href=a>1</a> <br><a href=b>2</a><a href=c>3</a>", 1, 2), ("C_46.0", "<a href=a>1</a> | <a href=b>2</a><p></p><a href=b>3</a>", 0, 0), ("C_46.0", "<a href=a>1</a><a href=b>2</a><a href=a>3</a><a href=b>4</a>", 2, 4),
    ("C_48.0", "<menuitem></menuitem>", 1, 1), ("C_48.0", f"{_4}<frameset><frame></frameset>", 0, 0), ("C_48.0", f"{_5}<frameset><frame><frame></frameset>", 2, 3), ("C_48.1", "<applet></applet><applet></applet>", 1, 2), ("C_48.1", "<p></p>", 0, 0), ("C_48.2", "<font>a</font><center>b</center><s>c</s><big>d</big>", 3, 3), ("C_48.2", f"{_5}<s>c</s>", 0, 0),
    ("C_48.3", "<dir></dir><menu></menu>", 2, 2), ("C_48.3", f"{_5}<menu></menu>", 0, 0), ("C_48.4", "<isindex><isindex>", 1, 2), ("C_48.5", "<listing></listing><xmp></xmp><xmp></xmp>", 2, 3), ("C_48.6", "<b>a</b><b>b</b><i>c</i>", 2, 3), ("C_48.6", f"{_5}<b>a</b>", 0, 0), ("C_48.7", f"{_5}<acronym>a</acronym>", 1, 1), ("C_48.7", "<acronym>a</acronym>", 0, 0),
    ("C_48.8", f"{_5}<img longdesc=u><table summary=''></table>", 2, 2), ("C_48.8", "<img longdesc=u>", 0, 0), ("C_80.0", f"<p alt='{'x' * 151}'></p>", 1, 1), ("C_80.0", f"<img alt='{'x' * 150}'>", 0, 0),
    ("C_300.1", "<map name=m><area alt='area' href=u><area alt=' '><area alt='Town hall'></map><img usemap='#m'><img usemap='#m'>", 2, 2), ("C_300.1", "<map name=m><area alt='a b c d'></map><img usemap='#m'>", 0, 0), ("C_300.1", "<map name=m><area alt='photo.jpg'><area alt='バナー 線 x'></map><img usemap='#m'>", 2, 2),
    ("C_3.1", "<img longdesc=''>", 1, 1), ("C_3.1", f"{_5}<img longdesc=u>", 0, 0), ("C_4.0", "<img width=100 height=100 alt='日本語 の 図'>", 1, 1), ("C_4.0", "<img alt='日本語 の 図'><img width=60 height=5 alt='日本語 の 図'><img width=100 height=100 alt='one two three'>", 0, 0), ("C_4.0", "<img width=60 height=30 alt='日本語 の 図'><img width='5%' alt='日本語 の 図'>", 1, 2),
    ("C_7.0", "<map><area href='/y'><area></map>", 2, 0), ("C_7.0", "<a href='/X'>x</a><map><area href='/x'></map>", 0, 0), ("C_8.0", "<font color=red>a</font><font bgcolor=red>b</font>", 1, 2), ("C_8.0", "<font color=''>a</font>", 0, 0),
    ("C_12.0", _NEST, 1, 1), ("C_12.0", _FLAT, 0, 0), ("C_12.1", _NEST + _FLAT, 2, 2), ("C_12.1", _DATA, 0, 0), ("C_12.2", _FORM, 1, 1), ("C_12.2", _DATA + _FORM.replace("input", "button"), 0, 0), ("C_12.2", _DATA.replace("<td>d", "<td>" + "<img>" * 11), 1, 1),
    ("C_15.0", "<h1>a</h1><h6>b</h6>", 1, 2), ("C_15.0", "<p></p>", 0, 0), ("C_16.1", "<ul></ul><ol><p>a</p></ol>", 2, 2), ("C_16.1", "<ul><p><ol><li>a</ol></ul>", 0, 0), ("C_16.2", "<li>a</li><li>b</li> <li>c</li>", 2, 4), ("C_16.2", "<ul><div><li>a</li></div></ul>", 0, 0),
    ("C_17.0", "<q></q><blockquote><b></b></blockquote>", 2, 2), ("C_17.0", "<q> </q>", 0, 0), ("C_17.1", "<blockquote>a</blockquote><blockquote></blockquote>", 1, 2), ("C_17.1", "<q></q>", 0, 0), ("C_18.0", "<q>longer than ten</q>", 1, 1), ("C_18.0", "<q>short</q>", 0, 0), ("C_18.1", "<blockquote></blockquote>", 1, 1), ("C_18.1", "<blockquote>longer than ten</blockquote>", 0, 0),
    ("C_23.0", _NEST.replace("<td>a", "<th>a"), 0, 0), ("C_23.0", _NEST.replace("<table>", "<table><caption>c</caption>"), 1, 1), ("C_23.0", _NEST.replace("<table>", "<table summary=''>"), 0, 0), ("C_23.1", _HEAD + _HEAD, 1, 2), ("C_23.1", _5 + _DATA.replace("<table>", "<table summary='s'>"), 0, 0), ("C_23.1", _DATA.replace("<table>", "<table summary='s'>"), 1, 1),
    ("C_25.1", _DATA, 1, 1), ("C_25.1", "<p id=n>name</p>" + _DATA.replace("<table>", "<table aria-labelledby='n'>"), 0, 0), ("C_25.1", _DATA.replace("<table>", "<table><caption></caption>"), 0, 0), ("C_25.2", _DATA.replace("<table>", "<table summary=''>"), 1, 1), ("C_25.2", _5 + _DATA, 0, 0), ("C_25.3", _DATA.replace("<table>", "<table><caption></caption>"), 1, 1), ("C_25.3", _DATA, 0, 0), ("C_25.4", _DATA.replace("<table>", "<table summary='s'>"), 1, 1), ("C_25.4", _DATA, 0, 0),
    ("C_26.0", f"<table><tr><th>{'x' * 31}</th></tr></table>", 1, 1), ("C_26.0", f"<table><tr><th>{'x' * 30}</th></tr></table>", 0, 0), ("C_30.0", "<object></object><embed>", 1, 2), ("C_30.0", "<p></p>", 0, 0), ("C_30.1", "<applet></applet>", 1, 1), ("C_32.0", "<object></object><object></object>", 1, 0), ("C_32.0", "<embed>", 0, 0),
    ("C_35.0", "<img width=60 height=60 src='a.GIF'>", 1, 1), ("C_35.0", "<img src='a.gif'><img width=60 height=60 src='.gif'><img width=60 height=60 src='a.gif?x'>", 0, 0), ("C_58.0", "<a href='a'>詳細</a><a href='b'>詳細</a><a href='a'>詳細</a>", 1, 2), ("C_58.0", "<a href='a'>詳細</a><a href='A'>詳細</a>", 0, 0),
    ("C_75.0", _DATA, 1, 1), ("C_75.0", _HEAD, 0, 0), ("C_76.1", 2 * _DATA.replace("<td>d", "<td colspan='2'>d"), 1, 2), ("C_76.1", _DATA.replace("<td>d", "<td colspan='1'>d"), 0, 0), ("C_86.0", "<a href='a.ogg'>x</a><a href='b.mp3'>y</a>", 1, 0), ("C_86.0", "<param value='a.mp3'><a href='a.swf'>x</a>", 0, 0), ("C_86.0", "<applet><param value='a.MP3'></applet>", 1, 0),
    ("C_300.5", "<canvas></canvas>", 1, 1), ("C_300.5", "<p></p>", 0, 0), ("C_388.0", "<form></form><form></form>", 1, 2), ("C_388.0", "<p></p>", 0, 0),
    ("C_500.17", "<p style='color: red'>a</p><p style='background: red; color:blue'>b</p>", 2, 2), ("C_500.17", "<p style='background-color: red'>a</p><p style='color:red;background-color:blue'>b</p><style>color: red</style>", 0, 0), ("C_500.17", "<style>p { color: red }</style>", 1, 1),
    ("C_500.18", "<p style='background-color: red'>a</p><style>p{background-color:red}</style>", 2, 2), ("C_500.18", "<p style='background: red'>a</p>", 0, 0), ("C_500.19", "<style>p { font-size: 12px }</style>", 1, 1), ("C_500.19", "<style>font-size: 12px</style><p style='font-size:1px'>a</p>", 0, 0),
    ("C_500.20", "<p style='font-size: 12px'>a</p>", 1, 1), ("C_500.20", "<p style='font-size: 120%'>a</p><p style='font-size: var(--px)'>b</p>", 0, 0), ("C_500.21", "<p style='font-size: 2vi'>a</p><style>p{font-size: 2vb}</style>", 2, 2), ("C_500.21", "<p style='font-size: 2em'>a</p>", 0, 0),
    ("C_19.0", "", 1, 0), ("C_600.14", "x", 1, 0), ("C_600.17", "x", 1, 0), ("C_600.19", "x", 1, 0), ("C_56.1", "x", 0, 0), ("C_56.1", "<a href=u>x</a>", 1, 0), ("C_81.0", "<a>x</a>", 0, 0), ("C_81.0", "<a href=u>x</a>", 1, 0),
]


def case_values() -> str:
    """The expected rows as SQL values: case_no, check_id, problems, nodes."""
    return ", ".join(f"({i}, '{c}', {p}, {n})" for i, (c, _, p, n) in enumerate(CASES))
