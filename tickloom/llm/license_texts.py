"""Fixed texts: the distinct terms of full licence texts, which is all that the scan needs of them."""

FULL = {
    "MIT": "a above action all an and any arising as associated authors be but c charge claim conditions connection contract copies copy copyright damages deal dealings distribute do documentation event express files fitness following for free from furnished granted hereby holders implied in included including is kind liability liable license limitation limited merchantability merge mit modify no noninfringement not notice obtaining of or other otherwise out particular permission permit person persons portions provided publish purpose restriction rights sell shall so software subject sublicense substantial the this to tort use warranties warranty whether whom with without",
    "Apache-2.0": "1 2 2.0 2004 3 4 5 50 6 7 8 9 a above acceptance accepting act acting acts add addendum additional additions advised against agree agreed agreement all alleging alone along alongside an and annotations any apache appear appendix applicable applies appropriateness are arising as asserted associated assume at attached attribution authorized authorship available b based basis be been behalf below beneficial bind but by c cannot carry cause changed character charge choose claim claims code combination commercial common communication compiled complies computer conditions configuration consequential consistent conspicuously constitutes construed contained content contents contract contribution contributions contributor contributory control controlled conversions copies copy copyright counterclaim cross customary d damages date defend defined definition definitions deliberate derivative derived describing designated determining different direct direction disclaimer discussing display distribute distributed distribution do document documentation does each editorial either elaborations electronic entities entity even event example except excluding exclusive executed exercise exercising explicitly express failure fee fifty file filed files fitness following for form free from generated give goodwill grant granted granting grants grossly harmless has have hereby herein hold however http i if ii iii implied import improving in inability incidental include included includes including inclusion incorporated incurred indemnify indemnity indicated indirect individual informational infringed infringement institute intentionally interfaces irrevocable is issue its january kind law lawsuit least legal liability liable licensable license licenses licensor limitation limited link lists litigation loss losses made mailing make making malfunction managed management marked marks may mean means mechanical media medium meet merchantability merely modifications modified modify modifying more must name names necessarily negligence negligent no non normally not nothing notice notices notwithstanding object obligations of offer on one only or org origin original other otherwise out outstanding own owner ownership part particular party patent percent perform permission permissions perpetual pertain places possibility power preferred prepare product prominent provide provided provides publicly purpose purposes readable reason reasonable received recipients redistributing redistribution regarding remain represent representatives reproduce reproducing reproduction required responsibility responsible result resulting retain revisions rights risks royalty s section sections sell sent separable separate service shall shares software sole solely source special state stated statement stating stoppage subject sublicense submission submit submitted subsequently such supersede support systems terminate terms text that the their then theory thereof third this those through title to tort tracking trade trademark trademarks transfer transformation translation types under union unless use using verbal version warranties warranty was where wherever whether which while whole whom with within without work works worldwide writing written www you your",
    "BSD-3-Clause": "1 2 3 a above advised all and any are arising as be binary business but by c caused code conditions consequential contract contributors copyright damage damages data derived direct disclaimed disclaimer distribution documentation endorse even event exemplary express fitness following for form forms from goods holder holders however if implied in incidental including indirect interruption is its liability liable limited list loss materials may merchantability met modification must name names negligence neither no nor not notice of on or other otherwise out particular permission permitted possibility prior procurement products profits promote provided purpose redistribution redistributions reproduce reserved retain rights services shall software source special specific strict substitute such that the theory this to tort use used warranties way whether with without written",
    "BSD-2-Clause": "1 2 a above advised all and any are arising as be binary business but by c caused code conditions consequential contract contributors copyright damage damages data direct disclaimed disclaimer distribution documentation even event exemplary express fitness following for form forms goods holder holders however if implied in incidental including indirect interruption is liability liable limited list loss materials merchantability met modification must negligence no not notice of on or other otherwise out particular permitted possibility procurement profits provided purpose redistribution redistributions reproduce reserved retain rights services shall software source special strict substitute such that the theory this to tort use warranties way whether with without",
    "GPL-2.0": "0 02110 1 10 11 12 1301 1989 1991 2 3 4 5 51 6 69 7 8 9 a above absence absolutely accept acceptance access accompanies accompany accord achieve act actions activities add addition address addressed advised aggregation agreed agreement all allegation allowed along also alter alternative among an and announcement another any anyone anything applicable application applies apply appropriate appropriately april are arising as ask associated assume at attach attempt author authors automatically avoid away b balance based be because been being believed below best binary body boston both bring but by c called can cannot carry case cause certain change changed changing charge choice choose circumstance circumstances claim claims clear clicks code collective comes commands commit compelled compilation compiler compilers complete compliance component components concerns conditions consequence consequential considered consistent conspicuously constantly constitute contact containing contains contents contest contradict contrast contributions control convey coon copies copy copying copyright copyrighted correction corresponding cost could countries counts course court covered customarily damages danger data date decide decision defective definition deny depends derivative derivatives derived designated designed detail details develop differ different directly disclaimer disclaims display distinguishing distribute distributed distributing distribution do document does donor each effect effectively either electronic else employer end enforcing entire entirely equivalent even event ever every everyone example except exception exceptions exchange excluded excluding exclusion excuse executable exercise explicit expressed expressly extend extent failure fee fifth file files finally fitness floor follow following for forbid form forming found foundation franklin free freedom from full further general generally generous geographical get give given gives gnomovision gnu goals granted grants gratis greatest guarantee guided hacker has have having he held here hereby herein hereinafter holder holders hope how however hypothetical idea identifiable if implemented implied impose imposed in inability inaccurate inc incidental include included including incorporate incorporates independent indicate indirectly individually induce information infringe infringement installation instead intact integrity intended intent interactive interactively interchange interest interface interfaces into introduced invalid is issues it items its itself james judgment june keep kernel kind know language later law least legal lesser liable license licensed licensee licensees licenses licensor like limitation limited line long loss losses ma machine made mail major make makes making many may means medium meet menu merchantability mere mode modification modifications modified modify modifying modules more most mouse must name names necessary need new no noncommercial normally not nothing notice notices number object obligations obtain of offer offering on one only operate operating option or order ordinary original other others otherwise our ours out output outside paper part particular parties parts party passed passes patent patents people performance performing permission permissions permit permitted pertinent physical physically pieces place placed places plus pointer portion possibility possible practices preamble precise preferred present preserving president prevent price print problems program programmer programs prohibited prominent promoting property proprietary protect protecting protection prove provide provided public publish published purpose quality range rather readable reads reason reasonably receive received receives recipient recipients redistribute redistribution redistributors refer referring refers reflect refrain regardless reliance remain rendered repair reputations required requirements responsibilities responsible rest restricted restrictions reuse revised right rights risk royalty run running runs s safest same sample satisfy say saying school scope scripts section sections see separate service servicing share sharing she short should show sign signature signed similar simultaneously since so software sole some someone something sometimes source speak special specifies specify spirit start started starts stated stating status steps storage street subject sublicense subsection such suits sure surrender sustained system take telling term terminate terminated terms than that the their them themselves then there therefore thereof these they things third this thoroughly those though threatened three through thus time to too transferring translate translated translation true two ty type under understands unenforceable unless up usa use used useful user users using valid validity verbatim version versions vice view void volume w want warranties warranty way we welcome what whatever when where whether which who whole whose wide will willing wish with without work works would write writing written wrote year years you your yoyodyne yyyy",
    "GPL-3.0": "0 1 10 11 12 13 14 15 16 17 1996 2 20 2007 28 29 3 30 4 5 6 60 6b 6d 7 8 9 a ability about above absence absolute absolutely abuse accept acceptance access accessible accompanied accompanies accord according achieve acknowledges acquired across actions activities activity actual actually adapt add added additional address addressed adopted adversely advised affects affero affirmed affirms after against aggregate agree agreed agreement aim all alleging allow allowed along already also alternative although among an ancillary and anti any anyone anything applicable applications applied applies apply appropriate appropriately approximates are area arise arising arrange arrangement article as asking assert assets associated assume assumption assumptions assures at attach attempt attributed attributions author authorization authorized authorizes authorizing authors automatic automatically available avoid away b based basic be because been behalf being believe below benefit best between beyond body both box brief business but by c called can cannot carry case cases cause cease certain cessation change changed changing characterized charge choose choosing circumstances circumvention civil claim claims class clear clearly closely code collect combination combine combined comes commands commercial commitment common communication compilation compilations compiler compliance comply component computer computers concerning concerns conditioned conditions connection consequence consequential consider considered consistent conspicuously constantly constitutes construed consumer contact contain containing contains content contents context continue continued contractual contradict contrast contributor control controlled convenient convey conveyance conveyed conveying conveys copies copy copying copyleft copyright copyrightable copyrighted correction corresponding cost could counterclaim countries country course court courts covenant coverage covered criterion cross cure customarily customer d damages danger data date days december decide declining deemed defective defenses defined definition definitions denied denominated deny denying deprive designated designed detail details determining develop developers development devices differ different differently direction directions directly disclaim disclaimer disclaiming discriminatory display displayed displays distinguishing distribute distributed distributing distribution do document documented does domains doubtful downstream durable dwelling dynamically e each earlier effect effected effective effectively efforts either electronic embodied employer enable enables end enforce enforcing ensure entered entire entirely entity equivalent erroneously essential even event ever every everyone exact example except exceptions excluded excluding exclusion exclusive exclusively excuse executable execute executing exercise exercising expected expects explains explicitly express expressed expressly extend extended extensions extent f facilities fails failure fair family fashion favor feature fee file files finally find first fitness fixed flow follow following for forbid force form format forms found foundation free freedom freedoms from fsf fulfilling full functioning fundamentally further future general generally generate get give given gives giving gnu governed gpl grant granted grants gratis greatest guarantee gui had has have having hereafter holder holders hope hosts household how however html http hypothetical idea identifiable if implement implementation implied import importing impose imposed in inability inaccurate inc incidental include included includes including inclusion incompatible incorporating incorporation indemnification independent indicate indicating individual individuals industrial inform information infringe infringed infringement initiate inside install installation installed instead intact intended intention interaction interactive interchange interest interface interfaces interfered interpretation interpreter intimate into invalidate irrevocable is it item its itself june keep kernel key keys kind kinds know knowingly knowledge language larger later law laws lawsuit least legal lesser lgpl liability liable libraries library license licensed licensee licensees licenses licensing licensors like likewise limit limitation limited limiting line link linked linking list litigation local long loss losses machine made mail maintain major make makes making manner manufacturer march marked marks masks material materially may meaning means measure measures medium meet meets menu merchantability mere merging met methods might misrepresentation mode model modification modifications modified modifies modify modifying more moreover most must name names nature necessary need needed neither network new next no non noncommercially nor normal normally not nothing notice notices notifies notify notwithstanding number numbered object obligate obligated obligations occasionally occurring occurs of offer offered offering official on one only operate operated operating operation option options or order org organization organizations origin original other others otherwise our out output outside own owned packaged packaging paper paragraph paragraphs part particular parties parts party pass password patent patents pattern payment peer peers performance performing permanently permission permissions permissive permit permits permitted perpetuity personal pertinent philosophy physical physically pieces place please plus pointer portion possesses possession possibility possible power practical practice preamble precise precisely predecessor preferred present presents preservation prevent prevented previous price primarily prior private problems procedures procuring produce product products program programmer programming programs prohibit prohibiting prohibits prominent prominently propagate propagating propagation property proprietary protect protecting protection protocols prove provide provided provision provisionally proxy public publicity publicly publish published purpose purposes pursuant qualify quality read readable readily reading ready reason reasonable receipt receive received receives receiving recipient recipients recognized redistribute referring refers refrain regard regardless regenerate reinstated relationship released relevant relicensing relying remain remains removal remove render rendered repair represent require required requirement requirements requires requiring resolved respect responsibilities responsible restrict restricting restriction restrictions result resulting results retains return reviewing revised right rights risk rom royalty rules run running runs s safest sake sale same satisfy saying school scope scripts secondarily section sections see sell selling semiconductor separable separate separately server serves service servicing shall share shared short should show sign significant similar simultaneously single so software sold sole solely some source spare speak special specific specifically specified specifies specify spirit stand standard standards start starts state stated statement states stating status steps storage subdividing subject sublicenses sublicensing subprograms subroutine subsection substantial substantially such sue suffice supplement support supports sure surrender survive sustained system systematic take tangible technological tells term terminal terminate terminated terminates termination terms than that the their them then there therefore these they things third this those though threatened three through thus time to too tools trade trademark trademarks transaction transfer transferred transferring transmission treated treaty two type typical unacceptable under unless unlimited unmodified unnecessary unpacking until updates use used useful user users uses using valid verbatim version versions view violates violation visible void volume w waive waiver want warranties warranty was way ways we welcome well were what whatever when where whether which who whole whom whose why widely will window wipo wish with within without work working works worldwide would writing written www year years you your yourself",
    "LGPL-3.0": "0 1 2 2007 29 3 4 4d0 4d1 5 6 a acceptance accessors accompany accompanying additional address allowed already also among an and any applicable application applications applies apply are argument as at authorization b based be being below both bound but by c called can certain changing choice choose class code combined combining compatible computer concerns conditions considered contained convey conveyed conveying copies copy copyright corresponding covered d data debugging decide deemed defined defining definitions detail differ directing displays distinguishing distribute do document does during e each effectively effort either engineering ensure event ever everyone exception excluding execute execution explaining extent facilities facility faith fewer file files find following for form foundation free from fsf function functions future general give given gnu good governed gpl have header herein https if in inc include including incorporate incorporated incorporates incorporating information inline install installation interface invoked is isolation it its june later layouts length lesser libraries library license limited lines linked linking listed macros made make makes manner material may meaningful means mechanism minimal mode modification modifications modified modify must necessary needed new none not notice notices number numbered numerical object of on one only operate operates option or org other otherwise parameters part particular passed performs permanent permissions permit permitted place portions present problems produce produced programs prominent properly provide provided proxy public publish published purpose received recombine recombining reference refers relink relinking remains reproducing required restrict reverse revised run s same section sections shall shared side similar single small software source specified specifies specify spirit statement still structure subclass such suitable supplemented supplied supply system taken templates ten terms than that the then these this time to together uncombined under use used user uses using utility verbatim version versions was well whatever when where whether which will with without work works would you your",
    "Unlicense": "a act action all an and any anyone arising as at author authors be benefit binary but by claim code commercial compile compiled connection contract copy copyright damages dealings dedicate dedication detriment distribute domain either event express fitness for form free from future heirs http implied in including information intend interest into is jurisdictions kind large law laws liability liable limited make means merchantability modify more no non noninfringement not of or org other otherwise our out overt particular perpetuity please present provided public publish purpose recognize refer released relinquishment rights sell shall software source successors that the this to tort under unencumbered unlicense use warranties warranty we whether with without",
    "MPL-2.0": "1 1.1 1.10 1.11 1.12 1.13 1.14 1.2 1.3 1.4 1.5 1.6 1.7 1.8 1.9 10 10.1 10.2 10.3 10.4 2 2.0 2.1 2.2 2.3 2.4 2.5 2.6 2.7 3 3.0 3.1 3.2 3.3 3.4 3.5 30 4 5 5.1 5.2 5.3 50 6 60 7 8 9 a ability able above absence absolutely accurate actions add addition additional additionally affect affero after against agree agreement agreements all alleging allow alone also alter an and any anyone apparatus applicable application apply are as asserting assume at attached attempt authorized automatically available b back basis be become been behalf believes beneficial bring brought business but by c can case cause caused character charge choice choose circumstances claim claims clear code combination combines come commercial common complete compliance compliant comply computer concerning conditions conflict consequential constitutes construe construed contained contains contents contract contribute contributes contribution contributions contributor contributors control controlled controls conveyed copy copyright correction cost counter courts covered create creates creation cross damages date days dealing death declaratory defective defects defendant defined definition definitions deletion describe described description desirable detailed different differs direct direction directly directory disclaimer disclaimers display distinguishing distribute distributed distributes distributing distribution distributions distributors do doctrines document does drafter due each earlier effect effective either end enforceable entire entities entity equivalents essential even event every except excluding exclusion exclusive executable exercising exhibit explicitly exploit expressed extent factual fail fails failure fair fee fifty file files finally first fit following for form foundation free from further general given gnu goodwill governed grant granted grants has have having held hereby hereof how however https i if ii implied import impossible in inability inaccuracies incidental include included includes including incompatible incurred indemnify indemnity indirect indirectly individual inform informed infringed infringement infringements infringes infringing initial initiate injury intellectual intended into is it its judgment judicial jurisdiction jurisdictions kind known language larger later law laws legal lesser liability liable licensable license licenses licensing likely limit limitation limitations litigation location logos look loss losses lost made maintains make makes making malfunction management manner marks material matter maximum may means merchantable method miscellaneous modification modifications modified modify more moreover mozilla mpl must name necessary negligence new no non not note nothing notice notices notifies notify notwithstanding number obligation obligations obtain of offer offered offering on one ongoing only option or order ordinary org original originally other others otherwise outstanding own ownership owns part particular party patent percent perform performance permits permitted personal place placed portions possibility possible power preferred prevent principal prior process profits prohibited prohibits property prove provided provides provision provisionally provisions public publish published purpose purposes put quality reasonable receipt received recipient recipients reference references reformed regulation reinstated relating relevant remedy remove removed rename repair representation represents reproduce required requirements resellers respect responsibilities restrict result resulting results right rights risk royalty s sale scope secondary section sections see sell selling separate service servicing shall shares should skill so software some source special specific statute statutory steward stoppage subject sublicense subsequent subsequently substance such sufficient sufficiently support survive terminate terminates termination terms text than that the their then theory thereof they third this those time timely to tort trademark trademarks transfer under understand unenforceable unless unmodified until use used user using v validly version versions want warranties warranty was where whether which who wide will with within without work world would you your",
}
